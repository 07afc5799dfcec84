"""Declared input schemas."""

from pyspark.sql import types as T

AUTHOR = T.StructType([
    T.StructField("auid", T.StringType()),
    T.StructField("Authorseq", T.IntegerType()),
    T.StructField("given_name_pn", T.StringType()),
    T.StructField("surname_pn", T.StringType()),
    T.StructField("initials_pn", T.StringType()),
    T.StructField("indexed_name_pn", T.StringType()),
    T.StructField("indexed_name", T.StringType()),
])

AFFILIATION_LINK = T.StructType([
    T.StructField("Authorseq", T.IntegerType()),
    T.StructField("affiliation_seq", T.IntegerType()),
])

AFFILIATION = T.StructType([
    T.StructField("afid", T.LongType()),
    T.StructField("affiliation_organization", T.ArrayType(T.StringType())),
    T.StructField("affiliation_tag_country", T.StringType()),
])

PUBLICATIONS = T.StructType([
    T.StructField("eid", T.LongType()),
    T.StructField("year", T.IntegerType()),
    T.StructField("datesort", T.DateType()),
    T.StructField("publication_type", T.StringType()),
    T.StructField("dbcollections", T.ArrayType(T.StringType())),
    T.StructField("references", T.ArrayType(T.LongType())),
    T.StructField("source", T.StructType([T.StructField("srcid", T.LongType())])),
    T.StructField("Au", T.ArrayType(AUTHOR)),
    T.StructField("Au_af", T.ArrayType(AFFILIATION_LINK)),
    T.StructField("Af", T.ArrayType(AFFILIATION)),
])

INSTITUTIONS = T.StructType([
    T.StructField("afid", T.LongType()),
    T.StructField("preferred_name", T.StringType()),
])

PAPER_SUBFIELD = T.StructType([
    T.StructField("eid", T.LongType()),
    T.StructField("subfield_hybrid", T.StringType()),
])

LABELS = T.StructType([
    T.StructField("domain", T.StringType()),
    T.StructField("field", T.StringType()),
    T.StructField("subfield", T.StringType()),
])

DISCONTINUED = T.StructType([T.StructField("srcid", T.LongType())])
