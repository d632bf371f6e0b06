"""Names of geoid models and the grid files they stand for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Grid file of each name and alias.
GRIDS = """
geoid18_conus us_nga_geoid18_conus.tif
geoid12b_conus g2012b_conus.gtx
geoid12a_conus g2012a_conus.gtx
geoid09_conus g2009_conus.gtx
geoid06_conus g2006_conus.gtx
geoid03_conus g2003_conus.gtx
geoid99_conus g1999_conus.gtx
geoid18_ak us_nga_geoid18_ak.tif
geoid12b_ak g2012b_ak.gtx
geoid12a_ak g2012a_ak.gtx
geoid09_ak g2009_ak.gtx
geoid06_ak g2006_ak.gtx
geoid03_ak g2003_ak.gtx
geoid99_ak g1999_ak.gtx
geoid12b_hi g2012b_hi.gtx
geoid12a_hi g2012a_hi.gtx
geoid09_hi g2009_hi.gtx
geoid06_hi g2006_hi.gtx
geoid03_hi g2003_hi.gtx
geoid99_hi g1999_hi.gtx
geoid18_prvi us_nga_geoid18_prvi.tif
geoid12b_prvi g2012b_prvi.gtx
geoid12a_prvi g2012a_prvi.gtx
geoid09_prvi g2009_prvi.gtx
geoid03_prvi g2003_prvi.gtx
geoid99_prvi g1999_prvi.gtx
geoid18_guamnmi us_nga_geoid18_guamnmi.tif
geoid03_guam g2003_guam.gtx
geoid18_samoa us_nga_geoid18_samoa.tif
geoid03_samoa g2003_samoa.gtx
vertcon_conus vertcon_conus.gtx
vertcon_ak vertcon_ak.gtx
egm2008_1 egm08_1.gtx
egm2008 egm08_25.gtx
egm96 egm96_15.gtx
egm84 egm84-30.gtx
cgg2013a ca_geoid_CGG2013a.gtx
ht2_2010v70 ca_ht2_2010v70.gtx
ausgeoid2020 au_ga_AUSGeoid2020.gtx
ausgeoid09 au_ga_AUSGeoid09.gtx
osgm15 uk_osgm15.gtx
egg2008 eg_eur_eggm08.gtx
nkg2015 is_lmi_NKG2015.gtx
gcg2016 de_bkg_GCG2016.gtx
raf20 fr_ign_RAF20.gtx
chgeo2004 ch_ln02_CHGeo2004.gtx
rednap es_ign_EGM08_REDNAP.gtx
italiageo04 it_gm_igmi2004.gtx
nzgeoid2016 nz_linz_nzgeoid2016.gtx
gsigeo2011 jp_gsi_gsigeo2011.gtx
kngeo18 kr_ngii_kngeo18.gtx
mapgeo2015 br_ibge_MAPGEO2015.gtx
argeo-ar ar_ign_SR-GEO-AR.gtx
sageoid2010 za_geoid2010.gtx
geoid18 us_nga_geoid18_conus.tif
g18 us_nga_geoid18_conus.tif
geoid12b g2012b_conus.gtx
g12b g2012b_conus.gtx
geoid12a g2012a_conus.gtx
g12a g2012a_conus.gtx
geoid09 g2009_conus.gtx
g09 g2009_conus.gtx
geoid06 g2006_conus.gtx
g06 g2006_conus.gtx
geoid03 g2003_conus.gtx
g03 g2003_conus.gtx
geoid99 g1999_conus.gtx
g99 g1999_conus.gtx
egm08 egm08_25.gtx
geoid18alaska us_nga_geoid18_ak.tif
g18ak us_nga_geoid18_ak.tif
geoid12balaska g2012b_ak.gtx
g12bak g2012b_ak.gtx
geoid09alaska g2009_ak.gtx
g09ak g2009_ak.gtx
geoid12bhawaii g2012b_hi.gtx
g12bhi g2012b_hi.gtx
geoid09hawaii g2009_hi.gtx
g09hi g2009_hi.gtx
geoid18puertorico us_nga_geoid18_prvi.tif
g18prvi us_nga_geoid18_prvi.tif
geoid12bpuertorico g2012b_prvi.gtx
g12bprvi g2012b_prvi.gtx
geoid18guam us_nga_geoid18_guamnmi.tif
g18guam us_nga_geoid18_guamnmi.tif
geoid18samoa us_nga_geoid18_samoa.tif
g18samoa us_nga_geoid18_samoa.tif
vertcon vertcon_conus.gtx
vertconalaska vertcon_ak.gtx
ausgeoid20 au_ga_AUSGeoid2020.gtx
ausgeoid9 au_ga_AUSGeoid09.gtx
ukgeoid uk_osgm15.gtx
britaingeoid uk_osgm15.gtx
germanygeoid de_bkg_GCG2016.gtx
francegeoid fr_ign_RAF20.gtx
switzerlandgeoid ch_ln02_CHGeo2004.gtx
spaingeoid es_ign_EGM08_REDNAP.gtx
italygeoid it_gm_igmi2004.gtx
japangeoid jp_gsi_gsigeo2011.gtx
newzealandgeoid nz_linz_nzgeoid2016.gtx
brazilgeoid br_ibge_MAPGEO2015.gtx
"""


def registry(spark: SparkSession) -> DataFrame:
    """alias and grid."""
    return spark.createDataFrame([tuple(line.split()) for line in GRIDS.strip().splitlines()], "alias string, grid string")
