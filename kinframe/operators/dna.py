"""DNA matches: segments read from notes, and the common ancestors they may come from."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinframe.operators.graph import nearest, parent_edges, relation_label
from kinframe.plans.checkpoints import cut
from kinframe.tree import Tree

#: Chromosomes by their usual names, and the sides a segment may be said to be on.
CHROMOSOMES = (*map(str, range(1, 23)), "X", "Y", "MT")
SIDES = ("M", "P", "U")
SEGMENT_DDL = "struct<line:int,chromosome:string,start:bigint,stop:bigint,side:string,cm:double,snps:bigint,comment:string,fault:string>"


def _whole(text: Column) -> Column:
    """A whole number, thousands perhaps set off by commas, dots or blanks; null if it is none."""
    return F.when(text.rlike(r"^[0-9]+$"), text.try_cast("bigint")).when(text.rlike(r"^\d{1,3}([,. ]\d{3})+$"), F.translate(text, ",. ", "").try_cast("bigint"))


def segments(notes: DataFrame, text: str = "text.string") -> DataFrame:
    """(note, line, chromosome, start, stop, side, cm, snps, comment, fault): one row for each line of each note that is not blank.

    A line has chromosome, start, stop and centimorgans, then perhaps the number of
    SNPs, the side (M, P or U) and a comment, parted by tabs, else semicolons, else commas. ``fault``
    names the first thing wrong with it, its other fields are then as far as they could be
    read: "fields" (fewer than four), "chromosome", "start", "stop", "stop before start", "cM", "SNPs".
    A first line whose start and stop hold no digit is a heading and left out. Lines are counted from 1.
    """
    return _lines(notes, F.col(text)).where("said").drop("said")


def _lines(notes: DataFrame, text: Column) -> DataFrame:
    """Every line of the notes as :func:`segments` has it, and whether it says anything: blank lines and headings don't."""
    lines = notes.select(F.col("handle").alias("note"), F.posexplode(F.split(text, r"\r\n|\n|\r")).alias("pos", "raw"))
    lines = lines.select("note", (F.col("pos") + 1).alias("line"), F.trim("raw").alias("raw"))
    parts = F.when(F.contains("raw", F.lit("\t")), F.split("raw", "\t")).when(F.contains("raw", F.lit(";")), F.split("raw", ";")).otherwise(F.split("raw", ","))
    lines = lines.withColumn("f", F.transform(parts, lambda x: F.trim(x)))
    at = lambda k: F.nullif(F.get("f", k), F.lit(""))
    digits = lambda k: F.coalesce(at(k).rlike("[0-9]"), F.lit(False))
    heading = (F.col("line") == 1) & (F.size("f") >= 3) & ~digits(1) & ~digits(2)
    chromosome = F.upper(F.regexp_replace(at(0), "(?i)^chr(omosome)? ?", ""))
    rows = lines.select(
        "note", "line", F.when(chromosome.isin(*CHROMOSOMES), chromosome).alias("chromosome"), _whole(at(1)).alias("start"), _whole(at(2)).alias("stop"),
        F.when(F.upper(at(5)).isin(*SIDES), F.upper(at(5))).otherwise("U").alias("side"),
        F.when(at(3).rlike(r"^\d+([.,]\d+)?$"), F.replace(at(3), F.lit(","), F.lit(".")).try_cast("double")).alias("cm"),
        _whole(at(4)).alias("snps"), at(6).alias("comment"), (F.size("f") < 4).alias("few"), at(4).isNotNull().alias("counted"), ((F.col("raw") != "") & ~heading).alias("said"),
    )
    fault = (
        F.when(F.col("few"), "fields").when(F.col("chromosome").isNull(), "chromosome").when(F.col("start").isNull(), "start").when(F.col("stop").isNull(), "stop")
        .when(F.col("stop") < F.col("start"), "stop before start").when(F.col("cm").isNull(), "cM").when(F.col("counted") & F.col("snps").isNull(), "SNPs")
    )
    return rows.withColumn("fault", fault).drop("few", "counted")


def associations(tree: Tree, relation: str = "DNA") -> DataFrame:
    """(person, person_ref_idx, match, note_list): the references from person to person of one relation, whatever its case."""
    refs = tree.person.select(F.col("handle").alias("person"), F.posexplode("person_ref_list").alias("person_ref_idx", "r"))
    return refs.where(F.lower("r.rel") == relation.lower()).select("person", "person_ref_idx", F.col("r.ref").alias("match"), F.coalesce("r.note_list", F.array().cast("array<string>")).alias("note_list"))


def dna_matches(tree: Tree, relation: str = "DNA", depth: int = 15) -> DataFrame:
    """(person, person_ref_idx, match, relation, ancestors, segments, note_handles, centimorgans, faults) of every match of every person.

    ``relation`` and ``ancestors`` are the most direct way by which the two are related in
    the tree, null and empty where there is none within ``depth`` generations. ``segments`` lists the
    lines of the match's notes that can be read, in the order of notes and lines, ``faults`` the
    others as "note:line fault". Notes that are not there are left out of ``note_handles``. Each note is
    parsed once, whatever number of matches refers to it, and its lines stay together on their way to the matches.
    """
    known = cut(associations(tree, relation))
    wanted = known.select("person", "person_ref_idx", F.posexplode("note_list").alias("n", "note"))
    notes = tree.note.join(wanted.select(F.col("note").alias("handle")).distinct().hint("merge"), "handle", "left_semi")
    whole = F.struct("line", "chromosome", "start", "stop", "side", "cm", "snps", "comment", "fault").cast(SEGMENT_DDL)
    good, bad = F.col("said") & F.col("fault").isNull(), F.col("said") & F.col("fault").isNotNull()
    # a line at least for each note that is there, so that none needs to be looked up apart from its lines
    read = _lines(notes, F.coalesce("text.string", F.lit(""))).groupBy("note").agg(
        F.collect_list(F.when(good, whole)).alias("segments"), F.sum(F.when(good, F.col("cm"))).alias("cm"),
        F.collect_list(F.when(bad, F.struct("line", F.concat("note", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "fault").alias("s")))).alias("faults"),
    )
    met = wanted.join(read.hint("merge"), "note").groupBy("person", "person_ref_idx")
    told = met.agg(F.array_sort(F.collect_list(F.struct("n", "note", F.array_sort("segments").alias("segments"), "cm", F.array_sort("faults").alias("faults")))).alias("r")).select(
        "person", "person_ref_idx", F.col("r.note").alias("note_handles"), F.flatten("r.segments").alias("segments"), F.flatten("r.faults")["s"].alias("faults"),
        F.aggregate("r.cm", F.lit(0.0), lambda x, y: x + F.coalesce(y, F.lit(0.0))).alias("centimorgans"),
    )
    ways = nearest(parent_edges(tree), known.select(F.col("person").alias("a"), F.col("match").alias("b")), depth)
    sexes = tree.person.select(F.col("handle").alias("match"), "gender")
    rows = known.drop("note_list").join(ways.select(F.col("a").alias("person"), F.col("b").alias("match"), "up", "down", "ancestors").hint("merge"), ["person", "match"], "left").join(sexes, "match", "left")
    rows = rows.join(told.hint("merge"), ["person", "person_ref_idx"], "left")
    empty = lambda kind: F.array().cast(kind)
    return rows.select(
        "person", "person_ref_idx", "match", relation_label(F.col("up"), F.col("down"), F.col("gender")).alias("relation"), F.coalesce("ancestors", empty("array<string>")).alias("ancestors"),
        F.coalesce("segments", empty(f"array<{SEGMENT_DDL}>")).alias("segments"), F.coalesce("note_handles", empty("array<string>")).alias("note_handles"),
        F.coalesce("centimorgans", F.lit(0.0)).alias("centimorgans"), F.coalesce("faults", empty("array<string>")).alias("faults"),
    )
