"""Coded dictionaries as small dimension tables. Joins are left to the optimiser: a dimension is broadcast if its size allows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: fixed values: coding scheme designators and their registered identifiers
SCHEMES = [
    ("ACR", "2.16.840.1.113883.6.76"),
    ("ASTM-sigpurpose", "1.2.840.10065.1.12"),
    ("C4", "2.16.840.1.113883.6.12"),
    ("C5", "2.16.840.1.113883.6.82"),
    ("caDSR", "2.16.840.1.113883.3.26.2"),
    ("CD2", "2.16.840.1.113883.6.13"),
    ("CTV3", "2.16.840.1.113883.6.6"),
    ("DC", "1.2.840.10008.2.16.10"),
    ("DCM", "1.2.840.10008.2.16.4"),
    ("DCMUID", "1.2.840.10008.2.6.1"),
    ("FMA", "2.16.840.1.113883.6.119"),
    ("HPC", "2.16.840.1.113883.6.14"),
    ("I10", "2.16.840.1.113883.6.3"),
    ("I10C", "2.16.840.1.113883.6.90"),
    ("I10P", "2.16.840.1.113883.6.4"),
    ("I11", "1.2.840.10008.2.16.16"),
    ("I9", "2.16.840.1.113883.6.42"),
    ("I9C", "2.16.840.1.113883.6.2"),
    ("ICDO3", "2.16.840.1.113883.6.43.1"),
    ("IBSI", "1.2.840.10008.2.16.13"),
    ("ISO639_1", "2.16.840.1.113883.6.99"),
    ("ISO639_2", "2.16.840.1.113883.6.100"),
    ("ISO3166_1", "2.16.1"),
    ("ITIS_TSN", "1.2.840.10008.2.16.7"),
    ("LN", "2.16.840.1.113883.6.1"),
    ("MA", "1.2.840.10008.2.16.5"),
    ("MAYOASRG", "1.2.840.10008.2.16.12"),
    ("MGI", "1.2.840.10008.2.16.8"),
    ("MSH", "2.16.840.1.113883.6.177"),
    ("NCIt", "2.16.840.1.113883.3.26.1.1"),
    ("NDC", "2.16.840.1.113883.6.69"),
    ("NEU", "2.16.840.1.113883.6.210"),
    ("NICIP", "2.16.840.1.113883.2.1.3.2.4.21"),
    ("NYUMCCG", "1.2.840.10008.2.16.11"),
    ("PATHLEX", "1.3.6.1.4.1.19376.1.8.2.1"),
    ("POS", "2.16.840.1.113883.6.50"),
    ("PUBCHEM_CID", "1.2.840.10008.2.16.9"),
    ("RADLEX", "2.16.840.1.113883.6.256"),
    ("RADELEMENT", "1.2.840.10008.2.16.15"),
    ("RFC3066", "2.16.840.1.113883.6.121"),
    ("RFC5646", "2.16.840.1.113883.6.316"),
    ("RO", "1.2.840.10008.2.16.14"),
    ("RRID", "1.2.840.10008.2.16.18"),
    ("RXNORM", "2.16.840.1.113883.6.88"),
    ("99SDM", "2.16.840.1.113883.6.53"),
    ("SNM3", "2.16.840.1.113883.6.51"),
    ("SCT", "2.16.840.1.113883.6.96"),
    ("SRT", "2.16.840.1.113883.6.96"),
    ("UBERON", "1.2.840.10008.2.16.6"),
    ("UCUM", "2.16.840.1.113883.6.8"),
    ("UMLS", "2.16.840.1.113883.6.86"),
    ("UNS", "1.2.840.10008.2.16.17"),
    ("UNKNOWN", "1.2.840.10008.2.999.999"),
    ("UPC", "2.16.840.1.113883.6.55"),
]


def with_priority(sources: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of the sources, where an earlier one's row of a key hides those of later ones."""
    ranked = reduce(lambda a, b: a.unionByName(b), (s.withColumn("_from", F.lit(i)) for i, s in enumerate(sources)))
    w = Window.partitionBy(key).orderBy("_from")
    return ranked.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank", "_from")


def look_up(df: DataFrame, code: str, dictionaries: Sequence[DataFrame], fallback: str | None = None) -> DataFrame:
    """Adds ``label`` of a code from (code, label) dictionaries in order of priority; null or the fallback if none has it."""
    known = with_priority(dictionaries, "code") if len(dictionaries) > 1 else dictionaries[0]
    out = df.join(known.withColumnRenamed("code", "_code"), F.col(code) == F.col("_code"), "left").drop("_code")
    return out if fallback is None else out.withColumn("label", F.coalesce("label", F.lit(fallback)))


def schemes(df: DataFrame) -> DataFrame:
    return df.sparkSession.createDataFrame(SCHEMES, "designator string, uid string")


def scheme_of(df: DataFrame, column: str) -> DataFrame:
    """Adds ``designator`` by a scheme's designator or identifier; of two with one identifier, the first."""
    d = schemes(df)
    names = d.select(F.col("designator").alias("code"), F.col("designator").alias("label")).unionByName(
        d.groupBy(F.col("uid").alias("code")).agg(F.min("designator").alias("label"))
    )
    return look_up(df, column, [names]).withColumnRenamed("label", "designator")


def look_up_or(df: DataFrame, code: str, dictionary: DataFrame, otherwise: str) -> DataFrame:
    """Adds ``label`` of a code, else that of the code ``otherwise``; a null code has the latter too."""
    general = dictionary.where(F.col("code") == otherwise).select(F.col("label").alias("_general"), F.lit(otherwise).alias("_code"))
    out = look_up(df, code, [dictionary]).withColumn("_code", F.lit(otherwise)).join(general, "_code", "left")
    return out.withColumn("label", F.coalesce("label", "_general")).drop("_general", "_code")


def localised(df: DataFrame, code: str, lang: str, labels: DataFrame, default_lang: str, fallback: str) -> DataFrame:
    """Adds ``label`` of a code in the language asked for, else in the default one, else the fallback. ``labels``: (code, lang, label); of several labels of a
    code in one language, the least counts."""
    labels = labels.where("lang IS NOT NULL").groupBy("code", "lang").agg(F.min("label").alias("label"))
    by_lang = labels.groupBy(F.col("code").alias("_code")).agg(F.map_from_entries(F.collect_list(F.struct("lang", "label"))).alias("_labels"))
    out = df.join(by_lang, F.col(code) == F.col("_code"), "left")
    found = F.coalesce(F.try_element_at("_labels", F.col(lang)), F.try_element_at("_labels", F.lit(default_lang)), F.lit(fallback))
    return out.withColumn("label", found).drop("_code", "_labels")


def in_turn(*lists: Column) -> Column:
    """Lists one after the other, absent ones as empty."""
    return F.array_compact(F.flatten(F.array(*(F.coalesce(x, F.array()) for x in lists))))


_STATES = "1.2.840.10008.5.1.4.1.1.11"
#: fixed values: classes of presentation states, as what follows their root, with their group
PRESENTATION_STATES = [
    ("1", "GRAYSCALE_SOFTCOPY", "BASIC_GRAYSCALE"),
    ("2", "COLOR_SOFTCOPY", "COLOR_BASED"),
    ("3", "PSEUDO_COLOR_SOFTCOPY", "COLOR_BASED"),
    ("4", "BLENDING_SOFTCOPY", "COLOR_BASED"),
    ("5", "XA_XRF_GRAYSCALE_SOFTCOPY", "SPECIALIZED"),
    ("6", "GRAYSCALE_PLANAR_MPR_VOLUMETRIC", "VOLUMETRIC"),
    ("7", "COMPOSITING_PLANAR_MPR_VOLUMETRIC", "VOLUMETRIC"),
    ("8", "ADVANCED_BLENDING", "ADVANCED_BLENDING"),
    ("9", "VOLUME_RENDERING_VOLUMETRIC", "VOLUMETRIC"),
    ("10", "SEGMENTED_VOLUME_RENDERING_VOLUMETRIC", "VOLUMETRIC"),
    ("11", "MULTIPLE_VOLUME_RENDERING_VOLUMETRIC", "VOLUMETRIC"),
    ("12", "VARIABLE_MODALITY_LUT_SOFTCOPY", "ADVANCED_LUT"),
]


def presentation_states(spark: SparkSession) -> DataFrame:
    """(uid, type, group) of each class of presentation states."""
    return spark.createDataFrame([(f"{_STATES}.{end}", kind, group) for end, kind, group in PRESENTATION_STATES], "uid string, type string, group string")
