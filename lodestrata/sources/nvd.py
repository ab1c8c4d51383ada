"""Vulnerability feeds in both JSON layouts, and technique bundles, as DataFrames of their items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .items import read_items

_LANG = "array<struct<lang:string,value:string>>"
#: Items of both layouts; a file may hold either or both.
V1 = f"""cve struct<CVE_data_meta:struct<ID:string>,description:struct<description_data:{_LANG}>,
  problemtype:struct<problemtype_data:array<struct<description:{_LANG}>>>,references:struct<reference_data:array<struct<name:string,tags:array<string>>>>>"""
V2 = f"cve struct<id:string,descriptions:{_LANG},weaknesses:array<struct<description:{_LANG}>>>"
#: An object of a bundle, or of a bare list.
OBJECT = """type string,revoked boolean,x_mitre_deprecated boolean,name string,description string,
  external_references array<struct<source_name:string,external_id:string,description:string>>,x_mitre_detection string,
  x_mitre_platforms array<string>,x_mitre_data_sources array<string>,kill_chain_phases array<struct<phase_name:string>>"""


def _text(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def _list(x: Column, kind: str = "array<string>") -> Column:
    return F.coalesce(x, F.array().cast(kind))


def _english(x: Column) -> Column:
    return F.transform(F.filter(_list(x, _LANG), lambda v: v["lang"] == "en"), lambda v: _text(v["value"]))


def read_feeds(spark: SparkSession, path: str) -> DataFrame:
    """Items of the feed files of a folder: feed (the file's path), key (the layout's name), place, item (its text).

    Undecodable bytes are replaced, a folder without feeds is empty, and a file that is no JSON fails.
    """
    return read_items(spark, path, ("CVE_Items", "vulnerabilities")).withColumnRenamed("file", "feed")


def _text_v1(c: Column) -> tuple[Column, Column]:
    """doc_id, text of an item of the older layout.

    Text: English descriptions, English problem types, then for each reference its name, unless
    that is empty or a link, and its tags.
    """
    problems = F.flatten(F.transform(_list(c["problemtype"]["problemtype_data"], f"array<struct<description:{_LANG}>>"), lambda p: _english(p["description"])))
    refs = F.flatten(F.transform(_list(c["references"]["reference_data"], "array<struct<name:string,tags:array<string>>>"), lambda r: F.concat(
        F.filter(F.array(_text(r["name"])), lambda n: (n != "") & ~n.startswith("http")), _list(r["tags"]))))
    return F.upper(_text(c["CVE_data_meta"]["ID"])), F.array_join(F.concat(_english(c["description"]["description_data"]), problems, refs), " ")


def _text_v2(c: Column) -> tuple[Column, Column]:
    """The same for the newer layout: English descriptions, then the first description of each weakness."""
    weak = F.filter(F.transform(_list(c["weaknesses"], f"array<struct<description:{_LANG}>>"), lambda w: F.get(w["description"], F.lit(0))["value"]), lambda v: v.isNotNull())
    return F.upper(_text(c["id"])), F.concat(F.array_join(_english(c["descriptions"]), " "), F.lit(" "), F.array_join(weak, " "))


def read_nvd(spark: SparkSession, path: str) -> DataFrame:
    """All items of the feeds in a folder, of both layouts; doc_id may repeat. Files are read once."""
    feeds = read_feeds(spark, path)
    both = feeds.select("feed", "key", "place", F.when(F.col("key") == "CVE_Items", F.from_json("item", V1, {"mode": "FAILFAST"})).alias("one"), F.when(F.col("key") == "vulnerabilities", F.from_json("item", V2, {"mode": "FAILFAST"})).alias("two"))
    one, two = _text_v1(F.col("one.cve")), _text_v2(F.col("two.cve"))
    old = F.col("key") == "CVE_Items"
    out = both.select(F.when(old, one[0]).otherwise(two[0]).alias("doc_id"), F.lit("nvd").alias("source"), F.when(old, one[1]).otherwise(two[1]).alias("text"), "feed", (F.col("place") + F.when(old, 0).otherwise(F.lit(1 << 40))).cast("long").alias("place"))
    return out.where("doc_id <> ''")


def read_stix(spark: SparkSession, path: str) -> DataFrame:
    """Objects of a bundle or of a bare list, with tid (null if there is none) and live."""
    o = read_items(spark, path, ("objects",), "*").select("place", F.from_json("item", OBJECT, {"mode": "FAILFAST"}).alias("o")).select("o.*", "place")
    tid = F.upper(F.get(F.filter(_list(F.col("external_references"), "array<struct<source_name:string,external_id:string,description:string>>"), lambda r: r["source_name"] == "mitre-attack"), F.lit(0))["external_id"])
    live = (F.col("type") == "attack-pattern") & ~F.coalesce("revoked", F.lit(False)) & ~F.coalesce("x_mitre_deprecated", F.lit(False)) & (_text(F.col("tid")) != "")
    return o.withColumn("tid", tid).withColumn("live", F.coalesce(live, F.lit(False)))


def techniques(stix: DataFrame) -> DataFrame:
    """tid, name, description, detection, platforms, data_sources, tactics of the live techniques."""
    return stix.where("live").select("tid", _text(F.col("name")).alias("name"), _text(F.col("description")).alias("description"), _text(F.col("x_mitre_detection")).alias("detection"),
                                     _list(F.col("x_mitre_platforms")).alias("platforms"), _list(F.col("x_mitre_data_sources")).alias("data_sources"), F.transform(
                                         _list(F.col("kill_chain_phases"), "array<struct<phase_name:string>>"), lambda p: p["phase_name"]).alias("phases"), "external_references")


def attack_corpus(stix: DataFrame) -> DataFrame:
    """doc_id, source, text of the live techniques: name, reference notes, description, detection, platforms, data sources, phases."""
    t = techniques(stix)
    notes = F.transform(_list(F.col("external_references"), "array<struct<source_name:string,external_id:string,description:string>>"), lambda r: _text(r["description"]))
    parts = F.concat(F.array("name"), notes, F.split("description", "\n", -1), F.array("detection"), F.col("platforms"), F.col("data_sources"), F.col("phases"))
    return t.select(F.col("tid").alias("doc_id"), F.lit("attack").alias("source"), F.array_join(parts, " ").alias("text"))


def technique_tactics(stix: DataFrame) -> DataFrame:
    """tid, tactic of all techniques, also of revoked ones; the last object of an id counts."""
    t = stix.where((F.col("type") == "attack-pattern") & (_text(F.col("tid")) != ""))
    last = t.groupBy("tid").agg(F.max_by("kill_chain_phases", "place").alias("phases"))
    return last.select("tid", F.explode("phases.phase_name").alias("phase")).select("tid", tactic_title(F.col("phase")).alias("tactic"))


def tactic_title(phase: Column) -> Column:
    return F.initcap(F.replace(phase, F.lit("-"), F.lit(" ")))
