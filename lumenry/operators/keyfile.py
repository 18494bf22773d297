"""Key files (sections of ``key=value`` lines) as long tables: parsing, marks, merging, comparing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.scalars import shift_ev
from ..model import METADATA, SHOT_SECTIONS, WHITE_BALANCE


def parse(texts: DataFrame) -> DataFrame:
    """``(path, line, raw, section, kind, key, value)`` from ``texts(path, text)``; lines count from 1 and keep their ends.

    Kind is ``section``, ``entry``, ``other`` for blank lines and comments, or ``bad`` for
    anything else, entries before the first section among them. A value may hold ``=``.
    """
    split = F.posexplode(F.filter(F.split("text", r"(?<=\n)"), lambda s: s != "")).alias("line", "raw")
    lines = texts.select("path", split).withColumn("line", F.col("line") + 1)
    plain = F.trim(F.regexp_replace("raw", r"[\r\n\t]", " "))
    head = plain.startswith("[") & plain.endswith("]")
    at = F.instr(plain, "=")
    kind = F.when((plain == "") | plain.startswith("#"), "other").when(head, "section").when(at > 0, "entry").otherwise("bad")
    lines = lines.select(
        "path", "line", "raw",
        F.when(head, F.expr("substring(raw, instr(raw, '[') + 1, length(rtrim(regexp_replace(raw, '[\\\\r\\\\n\\\\t]', ' '))) - instr(raw, '[') - 1)")).alias("head"),
        kind.alias("kind"),
        F.when(kind == "entry", F.trim(F.substring(plain, F.lit(1), at - 1))).alias("key"),
        F.when(kind == "entry", F.trim(F.substring(plain, at + 1, F.length(plain)))).alias("value"),
    )
    section = F.last("head", ignorenulls=True).over(W.partitionBy("path").orderBy("line"))
    parsed = lines.withColumn("section", section).drop("head")
    orphan = (F.col("kind") == "entry") & F.col("section").isNull()
    return parsed.withColumn("kind", F.when(orphan, "bad").otherwise(F.col("kind")))


def get(lines: DataFrame) -> DataFrame:
    """``(path, section, key, value)``: the last value of each key."""
    entries = lines.where("kind = 'entry'")
    return entries.groupBy("path", "section", "key").agg(F.max_by("value", "line").alias("value"))


def sections(lines: DataFrame) -> DataFrame:
    """``(path, section, first)``: names in order of first appearance."""
    return lines.where("kind = 'section'").groupBy("path", "section").agg(F.min("line").alias("first"))


def section_ranges(lines: DataFrame) -> DataFrame:
    """Half-open line ranges of every section, its header included."""
    ends = F.max("line").over(W.partitionBy("path").orderBy("line").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)) + 1
    heads = lines.withColumn("stop", ends).where("kind = 'section'")
    following = F.lead("line").over(W.partitionBy("path").orderBy("line"))
    return heads.select("path", "section", F.col("line").alias("start"), F.coalesce(following, "stop").alias("end"))


def marks(lines: DataFrame) -> DataFrame:
    """``(path, rank, color, in_trash, error)``; every occurrence is validated, the last counts, absent ones are 0."""
    own = lines.where("kind = 'entry' and section = 'General' and key in ('Rank', 'ColorLabel', 'InTrash')")
    number = F.col("value").try_cast("int")
    flag = F.lower("value").isin("true", "1")
    bad = F.when(F.col("key") == "InTrash", ~F.col("value").isin("true", "false", "1", "0")).otherwise(~F.coalesce(number.between(0, 5), F.lit(False)))
    last = lambda key, value: F.max_by(F.when(F.col("key") == key, value), F.when(F.col("key") == key, F.col("line")))
    found = own.withColumn("bad", bad).groupBy("path").agg(
        last("Rank", number).alias("rank"),
        last("ColorLabel", number).alias("color"),
        last("InTrash", flag).alias("in_trash"),
        F.min_by(F.concat_ws("=", "key", "value"), F.when(F.col("bad"), F.col("line"))).alias("error"),
    )
    error = F.col("error")
    every = lines.select("path").distinct().join(found, "path", "left")
    value = lambda c, none: F.when(error.isNull(), F.coalesce(c, F.lit(none))).alias(c)
    return every.select("path", value("rank", 0), value("color", 0), value("in_trash", False), "error")


def render(lines: DataFrame) -> DataFrame:
    """``(path, text)``: the lines put together again, byte for byte."""
    ordered = F.array_sort(F.collect_list(F.struct("line", "raw")))
    return lines.groupBy("path").agg(F.array_join(F.transform(ordered, lambda s: s["raw"]), "").alias("text"))


def changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(path, section, key, old, new)`` of values that differ between two sets of ``get`` rows."""
    key = ["path", "section", "key"]
    old, new = before.select(*key, F.col("value").alias("old")), after.select(*key, F.col("value").alias("new"))
    return old.join(new, key, "full").where(~F.col("old").eqNullSafe(F.col("new")))


def stays(section: Column, same_scene: bool = False) -> Column:
    """Whether a section belongs to the shot and not to its look."""
    own = section.isin([*SHOT_SECTIONS, METADATA])
    return own if same_scene else own | (section == WHITE_BALANCE)


def apply_look(target: DataFrame, reference: DataFrame, same_scene: bool = False) -> DataFrame:
    """``get`` rows of the target with the look sections of the reference instead of its own.

    Both carry ``path``; the reference's rows are joined to the target of the same path.
    """
    columns = ["path", "section", "key", "value"]
    kept = target.where(stays(F.col("section"), same_scene)).select(columns)
    return kept.unionByName(reference.where(~stays(F.col("section"), same_scene)).select(columns))


def compensated(profile: DataFrame, target: DataFrame, reference: DataFrame, how: str, ev: float = 0.0) -> DataFrame:
    """Exposure compensation of ``apply_look``: ``copy`` it, ``keep`` the target's, or ``shift`` the reference's by ``ev``."""
    if how == "copy":
        return profile
    own = (F.col("section") == "Exposure") & (F.col("key") == "Compensation")
    source = target if how == "keep" else reference
    base = source.select("path").distinct().join(source.where(own).select("path", "value"), "path", "left")
    value = F.round(F.coalesce(F.col("value").try_cast("double"), F.lit(0.0)) + (ev if how == "shift" else 0.0), 2)
    put = base.select("path", F.lit("Exposure").alias("section"), F.lit("Compensation").alias("key"), value.cast("string").alias("value"))
    return override(profile, put)


def override(profile: DataFrame, settings: DataFrame) -> DataFrame:
    """``profile`` with the values of ``settings`` in place of or beside its own."""
    key = ["path", "section", "key"]
    return profile.join(settings.select(key), key, "left_anti").select(*key, "value").unionByName(settings.select(*key, "value"))


def merge_settings(automatic: DataFrame, manual: DataFrame) -> DataFrame:
    """``(group, section, key, value, ord)``: manual values win, at the automatic place; new ones follow in order."""
    key = ["group", "section", "key"]
    last = manual.groupBy(*key).agg(F.max_by("value", "ord").alias("manual"), F.min("ord").alias("manual_ord"))
    own = automatic.groupBy(*key).agg(F.max_by("value", "ord").alias("automatic"), F.min("ord").alias("own_ord"))
    met = own.join(last, key, "full")
    order = F.row_number().over(W.partitionBy("group").orderBy(F.col("own_ord").asc_nulls_last(), "manual_ord", "section", "key"))
    return met.select(*key, F.coalesce("manual", "automatic").alias("value"), (order - 1).alias("ord"))


def adapt(target: DataFrame, preset: DataFrame, settings: DataFrame) -> DataFrame:
    """A preset's look on a target, then settings."""
    return override(apply_look(target, preset), settings)


def newline(lines: DataFrame) -> DataFrame:
    """``(path, eol)``: how the first line of each file ends, a line feed if in no known way."""
    first = F.min_by("raw", "line")
    return lines.groupBy("path").agg(F.when(first.endswith("\r\n"), F.lit("\r\n")).otherwise(F.lit("\n")).alias("eol"))


def _put_together(pieces: DataFrame) -> DataFrame:
    """Parsed lines from ``pieces(path, at, turn, raw)``."""
    ordered = F.array_sort(F.collect_list(F.struct("at", "turn", "raw")))
    return parse(pieces.groupBy("path").agg(F.array_join(F.transform(ordered, lambda s: s["raw"]), "").alias("text")))


def _ended(lines: DataFrame, paths: DataFrame, eol: DataFrame) -> DataFrame:
    """``(path, at, turn, raw)`` of ``lines``; in files of ``paths`` the last line gets an end if it has none."""
    size = lines.groupBy("path").agg(F.max("line").alias("size"))
    grown = paths.select("path", F.lit(True).alias("grows")).join(size, "path").join(eol, "path")
    met = lines.join(grown, "path", "left")
    open_ = F.col("grows") & (F.col("line") == F.col("size")) & ~F.col("raw").endswith("\n")
    raw = F.when(F.coalesce(open_, F.lit(False)), F.concat("raw", "eol")).otherwise(F.col("raw"))
    return met.select("path", F.col("line").cast("double").alias("at"), F.lit(0).cast("long").alias("turn"), raw.alias("raw"))


def set_values(lines: DataFrame, values: DataFrame) -> DataFrame:
    """``lines`` with ``values(path, section, key, value, ord, add)`` written into them.

    All places of a key are rewritten and keep their line ends; of values that repeat a key the last
    counts. A key that is missing is added, if ``add`` says so, behind the last entry of the first
    section of that name, in the order of ``ord``; a section that is missing is put at the end of the
    file, behind a blank line. A path without lines is an empty file.
    """
    key = ["path", "section", "key"]
    wanted = values.groupBy(*key).agg(F.max_by("value", "ord").alias("put"), F.min("ord").alias("ord"), F.max_by("add", "ord").alias("add"))
    entries = lines.where("kind = 'entry'").select(*key).distinct()
    eol = newline(lines)
    missing = wanted.join(entries, key, "left_anti").where("add").join(eol, "path", "left").withColumn("eol", F.coalesce("eol", F.lit("\n")))
    line_end = F.regexp_extract("raw", r"([\r\n]*)$", 1)
    met = lines.join(wanted.select(*key, "put"), key, "left")
    hit = (F.col("kind") == "entry") & F.col("put").isNotNull()
    written = met.withColumn("raw", F.when(hit, F.concat("key", F.lit("="), "put", line_end)).otherwise(F.col("raw"))).drop("put")

    header = lines.where("kind = 'section'").withColumn("after", F.lead("line").over(W.partitionBy("path").orderBy("line")))
    header = header.groupBy("path", "section").agg(F.min("line").alias("head"), F.min_by(F.struct("after"), "line").alias("next"))
    inside = lines.where("kind = 'entry'").select("path", "section", F.col("line").alias("entry"))
    reach = header.join(inside, ["path", "section"], "left").where("entry is null or next.after is null or entry < next.after or head = entry")
    reach = reach.groupBy("path", "section").agg(F.greatest(F.max("head"), F.coalesce(F.max("entry"), F.lit(0))).alias("spot"))
    known = header.select("path", "section").join(reach, ["path", "section"], "left").withColumn("found", F.lit(True))
    heads = header.select("path", "section", "head")
    placed = missing.join(known, ["path", "section"], "left").join(heads, ["path", "section"], "left")
    entry = F.concat("key", F.lit("="), "put", "eol")
    added = placed.where("found").select("path", F.coalesce("spot", "head").cast("double").alias("at"), (F.col("ord") + 1).cast("long").alias("turn"), entry.alias("raw"))

    new = placed.where("found is null")
    size = lines.groupBy("path").agg(F.max("line").alias("size"))
    new = new.withColumn("first", F.min("ord").over(W.partitionBy("path", "section"))).join(size, "path", "left")
    turn = F.dense_rank().over(W.partitionBy("path").orderBy("first", "section"))
    new = new.withColumn("at", (F.coalesce("size", F.lit(0)) + turn).cast("double")).withColumn("opens", F.col("ord") == F.col("first"))
    blank = F.when(F.col("size").isNull() & (F.col("at") == 1), F.lit("")).otherwise(F.col("eol"))
    heading = F.when(F.col("opens"), F.concat(blank, F.lit("["), "section", F.lit("]"), "eol")).otherwise(F.lit(""))
    new = new.select("path", "at", (F.col("ord") + 1).cast("long").alias("turn"), F.concat(heading, entry).alias("raw"))
    paths = placed.where("found is null").select("path").distinct()
    return _put_together(_ended(written, paths, eol).unionByName(added).unionByName(new))


def set_marks(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``lines`` with the marks of ``wanted(path, rank, color, in_trash)``; a rank of 0 is not added where there is none."""
    key = [F.lit("General").alias("section"), F.lit(True).alias("add")]
    rank = wanted.select("path", F.lit("Rank").alias("key"), F.col("rank").cast("string").alias("value"), F.lit(0).alias("ord"), key[0], (F.col("rank") > 0).alias("add"))
    color = wanted.select("path", F.lit("ColorLabel").alias("key"), F.col("color").cast("string").alias("value"), F.lit(1).alias("ord"), *key)
    trash = wanted.select("path", F.lit("InTrash").alias("key"), F.col("in_trash").cast("string").alias("value"), F.lit(2).alias("ord"), *key)
    return set_values(lines, rank.unionByName(color).unionByName(trash))


def replace_section(lines: DataFrame, source: DataFrame, name: str) -> DataFrame:
    """``lines`` with the section ``name`` of the ``source`` of the same path in place of all its own of that name.

    The first section of that name in the source counts; where it has none the section goes. The section stays
    at its first place or comes to the end, and its lines end as the file's do.
    """
    eol = newline(lines)
    own = source.withColumn("nth", F.count(F.when(F.col("kind") == "section", 1)).over(W.partitionBy("path").orderBy("line")))
    first = own.where((F.col("section") == name) & (F.col("kind") == "section")).groupBy("path").agg(F.min("nth").alias("nth"))
    taken = own.join(first, ["path", "nth"]).join(eol, "path")
    places = lines.groupBy("path").agg(F.min(F.when((F.col("kind") == "section") & (F.col("section") == name), F.col("line"))).alias("head"), F.max("line").alias("size"))
    taken = taken.join(places, "path").select(
        "path", F.coalesce("head", F.col("size") + 1).cast("double").alias("at"), F.col("line").cast("long").alias("turn"),
        F.concat(F.regexp_replace("raw", r"[\r\n]+$", ""), "eol").alias("raw"),
    )
    rest = lines.where((F.col("section") != name) | F.col("section").isNull())
    return _put_together(_ended(rest, places.where("head is null"), eol).unionByName(taken))


def adjustments(texts: DataFrame) -> DataFrame:
    """``(path, line, group, section, key, value, error)`` of ``[group]`` headers over ``Section.Key=value`` lines.

    Section and key part at the last dot before the first equals sign. A header is a row without a section, so that a
    group without settings is known. Blank lines and ``#`` comments are free; any other line is an error that names it.
    """
    split = F.posexplode(F.split("text", r"\r?\n")).alias("line", "raw")
    lines = texts.select("path", split).select("path", (F.col("line") + 1).alias("line"), F.trim(F.regexp_replace("raw", r"[\r\t]", " ")).alias("raw"))
    lines = lines.where(~((F.col("raw") == "") | F.col("raw").startswith("#")))
    head = F.when(F.col("raw").startswith("[") & F.col("raw").endswith("]"), F.expr("substring(raw, 2, length(raw) - 2)"))
    lines = lines.withColumn("head", head).withColumn("group", F.last(F.col("head"), ignorenulls=True).over(W.partitionBy("path").orderBy("line")))
    part = lambda k: F.when(F.col("head").isNull(), F.trim(F.regexp_extract("raw", r"^([^=]*)\.([^.=]*)=(.*)$", k)))
    good = F.col("raw").rlike(r"^[^=]*\.[^.=]*=")
    error = F.when(F.col("head").isNotNull(), None).when(F.col("group").isNull(), "a setting before any [group]").when(~good, "expected Section.Key=value")
    lines = lines.withColumn("error", F.when(error.isNotNull(), F.concat(F.lit("line "), F.col("line").cast("string"), F.lit(": "), error)))
    fine = F.col("error").isNull()
    return lines.select("path", "line", "group", *[F.when(fine, part(k)).alias(c) for k, c in ((1, "section"), (2, "key"), (3, "value"))], "error")


def group_settings(rows: DataFrame, group: str) -> DataFrame:
    """``(path, section, key, value, ord)`` of one group of ``adjustments``; none if it has no header."""
    return rows.where((F.col("group") == group) & F.col("section").isNotNull()).select("path", "section", "key", "value", F.col("line").alias("ord"))


def set_group(rows: DataFrame, settings: DataFrame) -> DataFrame:
    """``rows(group, section, key, value, ord)`` with the groups of ``settings`` in place of their own."""
    named = ["group", "section", "key", "value", "ord"]
    return rows.join(settings.select("group").distinct(), "group", "left_anti").select(named).unionByName(settings.select(named))


def automatic(preset: DataFrame, light: DataFrame) -> DataFrame:
    """``(path, section, key, value)``: the preset's exposure compensation shifted by the stops from ``light(path, reference, own)``.

    ``preset`` holds ``get`` rows. Luminances are linear; nothing is set where one of them is unknown. The shift is at most two
    stops, and none where a luminance is not positive: the preset's own value, or 0, is set then.
    """
    own = preset.where("section = 'Exposure' and key = 'Compensation'").select("path", F.col("value").try_cast("double").alias("had"))
    known = light.where("reference is not null and own is not null").join(own, "path", "left")
    shifted = F.round(F.coalesce("had", F.lit(0.0)) + shift_ev(F.col("reference"), F.col("own")), 2)
    return known.select("path", F.lit("Exposure").alias("section"), F.lit("Compensation").alias("key"), shifted.cast("string").alias("value"))
