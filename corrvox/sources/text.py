"""Text formats of point clouds, results, settings and run summaries, read and written as DataFrames of lines."""

from __future__ import annotations

import dataclasses
from functools import reduce
from itertools import groupby

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

C = F.col
# Fixed values of the formats: the header of result files and the keys of settings files.
DISP_COLUMNS = ("n", "x", "y", "z", "status", "objmin", "u", "v", "w")
SETTINGS_KEYS = (
    "reference_filename correlate_filename point_cloud_filename output_filename vol_bit_depth vol_endian vol_hdr_lngth vol_wide vol_high vol_tall "
    "subvol_geom subvol_size subvol_npts subvol_thresh gray_thresh_min gray_thresh_max min_vol_fract disp_max num_srch_dof obj_function interp_type "
    "rigid_trans basin_radius subvol_aspect num_points_to_process starting_point fine_search"
).split()


def lines_of(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, line) of a text file, numbered from 1 in the order of the file.

    The file is read in splits. Lines of a split follow each other, so a line's number is the number of lines in the
    splits before it (a row for each split is all that meets in one task) and its place in its own.
    """
    block = [C("_metadata.file_path").alias("file"), C("_metadata.file_block_start").alias("block")]
    rows = spark.read.text(path).select(*block, F.monotonically_increasing_id().alias("k"), C("value").alias("line"))
    splits = rows.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("k0"))
    before = F.sum("n").over(Window.orderBy("file", "block")) - C("n")
    numbered = rows.join(splits.select("file", "block", "k0", before.alias("before")), ["file", "block"])
    return numbered.select((C("before") + C("k") - C("k0") + 1).alias("line_no"), F.regexp_replace("line", "\r$", "").alias("line"))


def _bare(c: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(c, "^\\s+|\\s+$", "")


def number(c: Column) -> Column:
    """A number, or null if the text isn't one."""
    return c.try_cast("double")


def parse_points(lines: DataFrame) -> DataFrame:
    """(line_no, point_id, x, y, z) from ``n x y z`` lines (tabs, spaces or commas, # comments, a header).

    Lines without four numbers are errors from the first data line on; non-finite numbers always are.
    """
    body = F.trim(F.regexp_replace(F.regexp_replace("line", "#.*", ""), "[,\\s]+", " "))
    p = lines.select("line_no", body.alias("body")).where("body != ''")
    f = F.split("body", " ")
    vals = [number(F.get(f, F.lit(k))) for k in range(4)]
    p = p.select("line_no", "body", *[v.alias(n) for v, n in zip(vals, ("n", "x", "y", "z"), strict=True)])
    ok = C("n").isNotNull() & C("x").isNotNull() & C("y").isNotNull() & C("z").isNotNull()
    start = p.where(ok).agg(F.min("line_no").alias("first"))  # one row
    p = p.withColumn("ok", ok).join(F.broadcast(start)).where(C("ok") | (C("line_no") > C("first")))
    bad = F.concat(F.lit("line "), C("line_no").cast("string"), F.lit(": cannot read "), C("body"))
    odd = F.isnan("x") | F.isnan("y") | F.isnan("z") | (F.abs("x") == float("inf")) | (F.abs("y") == float("inf")) | (F.abs("z") == float("inf"))
    # The header's lines are told by their place here too: the filter may run after this.
    guard = F.when((C("line_no") >= C("first")) & (~C("ok") | F.coalesce(odd, F.lit(True))), F.raise_error(bad).cast("double")).otherwise(C("x"))
    return p.select("line_no", C("n").cast("long").alias("point_id"), guard.alias("x"), "y", "z")


def point_problems(points: DataFrame) -> DataFrame:
    """Reasons to refuse a cloud: (problem, point_id, count)."""
    bad = points.where(F.isnan("x") | F.isnan("y") | F.isnan("z")).select(F.lit("not finite").alias("problem"), "point_id", F.lit(1).cast("long").alias("count"))
    twice = points.groupBy("point_id").agg(F.count(F.lit(1)).alias("count")).where("count > 1").select(F.lit("repeated id").alias("problem"), "point_id", "count")
    return bad.unionByName(twice)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """A checked cloud in the order of the file (input_idx)."""
    p = parse_points(lines_of(spark, path))
    first = point_problems(p).first()
    if first is not None:
        raise ValueError(f"{path}: {first['problem']} (point {first['point_id']})")
    if not p.limit(1).count():
        raise ValueError(f"{path}: no points")
    return p.withColumnRenamed("line_no", "input_idx")


def significant(c: Column, digits: int = 9) -> Column:
    """``%.<digits>g`` of a number, trimmed as C prints it."""

    @F.pandas_udf("string")
    def fmt(v):
        plain = [f"%.{digits}g" % x for x in v.astype("float64").tolist()]  # null is nan
        return v.__class__(["0" if x == "-0" else x for x in plain])

    return fmt(c.cast("double"))


def result_lines(results: DataFrame, plain: bool = True) -> DataFrame:
    """Lines of a result file: points that aren't GOOD have no displacement, a criterion that isn't finite is 0."""
    good = C("status") == 0
    obj = F.when(F.isnan("objmin") | C("objmin").isNull() | (F.abs("objmin") == float("inf")), 0.0).otherwise(C("objmin"))
    num = (lambda c: F.format_string("%.6f", c)) if plain else significant
    uvw = [num(F.when(good, C(c)).otherwise(0.0)) for c in "uvw"]
    return results.select("point_id", F.concat_ws("\t", C("point_id").cast("string"), *[num(C(a)) for a in "xyz"], F.greatest("status", F.lit(-3)).cast("string"), num(obj), *uvw).alias("line"))


def parse_results(lines: DataFrame) -> DataFrame:
    """Columns of a result file's lines (after the header; further columns are kept out)."""
    f = F.split(_bare(C("line")), "\\s+")
    # The header is told by its first word here too: the filter that drops it may run after the casts.
    head = F.get(f, F.lit(0)) == DISP_COLUMNS[0]
    cols = [F.when(~head, F.get(f, F.lit(k)).cast("double")).alias(n) for k, n in enumerate(DISP_COLUMNS)]
    return lines.where(F.trim("line") != "").select(*cols).select(C("n").cast("long").alias("point_id"), "x", "y", "z", C("status").cast("int").alias("status"), "objmin", "u", "v", "w")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    lines = lines_of(spark, path)
    head = lines.where("line_no = 1").first()
    if head is None or tuple(head["line"].split()[: len(DISP_COLUMNS)]) != DISP_COLUMNS:
        raise ValueError(f"{path}: not a result file")
    return parse_results(lines.where("line_no > 1"))


def parse_settings(lines: DataFrame) -> DataFrame:
    """(line_no, key, value) of ``key value ### comment`` lines; a # after white space begins a comment too."""
    body = _bare(F.regexp_replace("line", "(###|(?<=\\s)#).*$", ""))
    p = lines.where(~_bare(C("line")).startswith("#")).select("line_no", body.alias("body")).where("body != ''")
    return p.select("line_no", F.regexp_extract("body", "^(\\S+)", 1).alias("key"), _bare(F.regexp_extract("body", "^\\S+\\s*(.*)$", 1)).alias("value"))


def settings_map(lines: DataFrame) -> DataFrame:
    """One row: all settings as a map (the last of a key counts) and the keys that aren't known."""
    p = parse_settings(lines)
    last = p.groupBy("key").agg(F.max_by("value", "line_no").alias("value"))
    known = F.array(*[F.lit(k) for k in SETTINGS_KEYS])
    return last.agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("settings"), F.array_sort(F.collect_list("key")).alias("keys")).select("settings", F.array_except("keys", known).alias("unknown"))


# Fixed values of the summaries: names of statuses, and those that other readers know (the rest counts as not searched).
STATUS_NAMES = {0: "GOOD", -1: "RANGE_FAIL", -2: "CONVG_FAIL", -3: "NOT_SEARCHED", -4: "THRESH_FAIL", -5: "SINGULAR"}
NUMBER_LABELS = {0: "successful", -1: "range fail", -2: "convg fail", -3: "not searched"}


def stat_lines(results: DataFrame, seconds: float, settings: str = "") -> DataFrame:
    """(place, line) of a run summary: points, seconds, rate, counts by status, counts and shares by the codes that others know,
    and the settings. One row for each status meets in one task."""
    n = results.groupBy("status").agg(F.count(F.lit(1)).alias("n"))
    known = F.when(C("status").isin(*NUMBER_LABELS), C("status")).otherwise(-3)
    total = n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"), *[F.coalesce(F.sum(F.when(known == c, C("n"))), F.lit(0)).alias(f"n{-c}") for c in NUMBER_LABELS])
    rate = F.format_string("%.3f", C("total") / F.lit(float(seconds))) if seconds > 0 else F.lit("nan")
    head = [F.lit("run summary"), F.format_string("points\t%d", "total"), F.lit(f"seconds\t{seconds:.3f}"), F.concat(F.lit("points_per_second\t"), rate)]
    tail = [F.lit(""), *[F.format_string(f"number {label} = %d\t(%.3f%%)", f"n{-c}", 100.0 * C(f"n{-c}") / F.greatest("total", F.lit(1))) for c, label in NUMBER_LABELS.items()], F.lit(""), F.lit("### config"), *[F.lit(x) for x in settings.splitlines()]]
    rows = F.array(*[F.struct(F.lit(place).alias("place"), line.alias("line")) for place, line in [*enumerate(head, -len(head)), *enumerate(tail, 1000)]])
    name = F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in STATUS_NAMES.items() for v in kv]), C("status")), C("status").cast("string"))
    return total.select(F.explode(rows).alias("r")).select("r.*").unionByName(n.select((-C("status")).alias("place"), F.format_string("status %s\t%d", name, C("n")).alias("line")))


# Fixed values of the summaries: how a rate is named before its number, and the units that follow one.
RATE_KEY, RATE_UNITS, RATE_PER = "points_per_second", ("point", "points", "pt", "pts"), "per"


def throughput(line: Column) -> Column:
    """Points per second named in a line, else null.

    The line is taken as words (a slash separates them too, and a number from the letters behind it). The number stands
    after the key, or before a unit that is followed by seconds.
    """
    spaced = F.regexp_replace(F.regexp_replace(F.lower(line), "[/=:]", " "), "(?<=[0-9])(?=p)", " ")
    words = F.split(F.btrim(spaced, F.lit(" \t\r\n")), "\\s+")

    def rate_at(i: Column) -> Column:
        word = F.get(words, i)
        second = F.get(words, i + F.when(F.get(words, i + 1) == RATE_PER, 2).otherwise(1)).startswith("sec")
        return F.when(word == RATE_KEY, F.get(words, i + 1)).when(word.isin(*RATE_UNITS) & second & (i > 0), F.get(words, i - 1)).try_cast("double")

    rates = F.transform(F.sequence(F.lit(0), F.size(words) - 1), rate_at)
    return F.get(F.filter(rates, lambda r: r.isNotNull() & ~F.isnan(r)), F.lit(0))


def write_lines(lines: DataFrame, path: str, order: str) -> None:
    """One ordered text file. The rows are the size of a report or a result, written by one task on purpose."""
    lines.orderBy(order).select("line").coalesce(1).write.mode("error").text(path)


# --- classic programs: settings, summaries and progress as they write them -----------------------------------


# A settings file's keys in their order. Each has its group (groups are set apart in an echo; the last one is not
# echoed), the run's value behind it, how it is written, and the value that must be set for it to be there.
SETTINGS_FORMAT = """
files   reference_filename     volumes.reference        text
files   correlate_filename     volumes.deformed         text
files   point_cloud_filename   points                   text
files   output_filename        output                   text
image   vol_bit_depth          image.bits               number
image   vol_endian             image.order              text     image.order
image   vol_hdr_lngth          image.header             number
image   vol_wide               image.wide               number
image   vol_high               image.high               number
image   vol_tall               image.tall               number
part    subvol_geom            subvolume.geometry       text
part    subvol_size            subvolume.size           number
part    subvol_npts            subvolume.n_samples      number
gray    subvol_thresh          search.limits.switch     text
gray    gray_thresh_min        search.limits.low        number   search.limits.low
gray    gray_thresh_max        search.limits.high       number   search.limits.low
gray    min_vol_fract          search.limits.share      number   search.limits.low
search  disp_max               search.disp_max          number
search  num_srch_dof           search.dof               number
search  obj_function           search.objective         text
search  interp_type            search.interpolation     text
start   rigid_trans            search.rigid_trans       triple
start   basin_radius           search.basin_radius      number
start   subvol_aspect          subvolume.aspect         triple
order   num_points_to_process  num_points_to_process    number
order   starting_point         start                    triple
"""
_FIELDS = [(*line.split(), None)[:5] for line in SETTINGS_FORMAT.strip().splitlines()]


def _written(value, how: str, gap: str = " ") -> str:
    if how == "triple":
        return gap.join(f"{float(v):g}" for v in value)
    return f"{float(value):g}" if how == "number" and not isinstance(value, int) else str(value)


def settings_lines(cfg, start: tuple[float, float, float], shape: tuple[int, int, int], dtype: str, header: int = 0) -> list[str]:
    """The lines of a classic settings file for a run's settings and its images' shape (x, y, z), type and header bytes."""
    if cfg.search.method != "fagn":
        raise ValueError("classic programs know the forward-additive method only")
    tree, bits, limits = dataclasses.asdict(cfg), 8 * np.dtype(dtype).itemsize, cfg.search.threshold
    order = None if bits == 8 else "big" if np.dtype(dtype).str[0] == ">" else "little"
    tree["image"] = {"bits": bits, "order": order, "header": header} | dict(zip(("wide", "high", "tall"), shape, strict=True))
    tree["search"]["limits"] = {"switch": "on" if limits else "off"} | dict(zip(("low", "high", "share"), limits or [None] * 3, strict=True))
    tree["start"] = start
    find = lambda at: reduce(lambda t, k: t[k], at.split("."), tree)
    rows = [(key, _written(find(source), how)) for _, key, source, how, needs in _FIELDS if needs is None or find(needs) is not None]
    # A comment after a tab ends each value: classic readers take a value up to the next tab.
    return ["### settings of a run", *[f"{k}\t{v}\t### run" for k, v in rows]]


def echo_lines(settings: dict[str, str], cloud: DataFrame, version: str = "corrvox") -> DataFrame:
    """(place, line): the head of a drop-in summary, the settings as they were understood and the cloud's size and bounding box.

    One row, the cloud's aggregates, meets in one task.
    """
    head = ["", "### echo of the input file for this run"]
    for group, fields in groupby(_FIELDS[:-2], key=lambda f: f[0]):
        head.append("")
        for _, key, _, how, _ in fields:
            if key in settings:
                value = settings[key].replace(",", " ").split()[:3] if how == "triple" else float(settings[key]) if how == "number" else settings[key]
                head.append(f"{key}\t{_written(value, how, chr(9))}")
    head += ["", "### end of input file echo", ""]
    corner = lambda f: F.array(*[f(a) for a in "xyz"])
    box = cloud.agg(F.count(F.lit(1)).alias("n"), corner(F.min).alias("low"), corner(F.max).alias("high"))
    shown = lambda c: F.array_join(F.transform(c, lambda v: F.regexp_replace(F.format_string("%.6f", v), "\\.?0+$", "")), " ")
    tail = [F.format_string("Point Cloud contains %d points", "n"), F.lit(""), F.format_string("\tbounding box min = [%s]", shown("low")), F.format_string("\tbounding box max = [%s]", shown("high")), F.lit(""), F.lit(f"running under {version}"), F.lit("")]
    return box.select(F.posexplode(F.array(*[F.lit(x) for x in head], *tail)).alias("place", "line"))


# The last lines of a drop-in summary, and what fills them.
CLOSING_FORMAT = (
    ("Run start:\t%s", ["start"]),
    ("Run finish:\t%s", ["finish"]),
    ("%d points processed in %.0f seconds", ["n", "seconds"]),
    ("%.3f sec/pt", ["each"]),
    ("%.3f pt/sec", ["rate"]),
    ("", []),
    ("number successful = %d\t(%.3f%%)", ["n0", "share0"]),
    ("number range fail = %d\t(%.3f%%)", ["n1", "share1"]),
    ("number convg fail = %d\t(%.3f%%)", ["n2", "share2"]),
    ("", []),
)


def closing_lines(results: DataFrame, start: float, finish: float, seconds: float) -> DataFrame:
    """(place, line): the end of a drop-in summary, times, rate and counts by status (one row meets in one task)."""
    counted = results.agg(F.count(F.lit(1)).alias("n"), *[F.count_if(C("status") == -k).alias(f"n{k}") for k in range(3)])
    most, took = F.greatest("n", F.lit(1)), F.lit(float(seconds))
    facts = {"seconds": took, "each": took / most, "rate": F.coalesce(F.try_divide(C("n"), took), F.lit(0.0)), **{f"share{k}": 100.0 * C(f"n{k}") / most for k in range(3)}}
    facts |= {name: F.date_format(F.timestamp_seconds(F.lit(float(at))), "yyyy-MM-dd HH:mm:ss") for name, at in (("start", start), ("finish", finish))}
    lines = [F.format_string(words, *named) if named else F.lit(words) for words, named in CLOSING_FORMAT]
    return counted.withColumns(facts).select(F.posexplode(F.array(*lines)).alias("place", "line"))


# What progress lines call the statuses.
PROGRESS_WORDS = {0: "Point_Good", -1: "Range_Fail", -2: "Convg_Fail"}


def progress_lines(results: DataFrame, total: int) -> DataFrame:
    """(place, line) of results that have a ``place``: count and total, label, position, status, and of GOOD points criterion and displacement."""
    head = F.format_string(f"%d/{total} %d\t%.3f %.3f %.3f \t", "place", "point_id", "x", "y", "z")
    moves = F.format_string("obj= %.6f%12s%.6f%12s%.6f%12s%.6f", "objmin", F.lit("dx= "), "u", F.lit("dy= "), "v", F.lit("dz= "), "w")
    word = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in PROGRESS_WORDS.items() for x in kv]), C("status")), F.lit("Not_Searched"))
    return results.select("place", F.concat(head, word, F.when(C("status") == 0, F.concat(F.lit("\t"), moves)).otherwise("")).alias("line"))


# The columns of the strain layouts.
_STRAIN_HEAD = ("n", "x", "y", "z", "u_fit", "v_fit", "w_fit", "pts_in_sw", "sw_radius")
_SIX = ("exx", "eyy", "ezz", "exy", "eyz", "exz")


def strain_lines(strain: DataFrame, points: DataFrame, layout: str) -> tuple[str, DataFrame]:
    """Header and (point_id, line) of a strain table as ``Lstr`` (large strain), ``Estr`` (small strain) or ``dgrd`` (gradient)."""
    if layout == "dgrd":
        names, values = [f"{u}{a}" for u in "uvw" for a in "xyz"], [F.get("grad", F.lit(k)) for k in range(9)]
    elif layout in ("Lstr", "Estr"):
        p = "l_" if layout == "Lstr" else ""
        names = [*_SIX, "ep1", "ep2", "ep3", *[f"sd_{c}" for c in _SIX]]
        values = [*[C(p + c) for c in _SIX], *[C(f"{p}ep{k}") for k in (1, 2, 3)], *[C(f"sd_{c}") for c in _SIX]]
    else:
        raise ValueError(f"unknown layout {layout!r}: Lstr, Estr or dgrd")
    g = lambda c: significant(c, 6)
    row = strain.join(points.select("point_id", *"xyz"), "point_id")
    cells = [C("point_id").cast("string"), *[g(C(c)) for c in ("x", "y", "z", "u_fit", "v_fit", "w_fit")], C("pts_in_sw").cast("string"), g(C("sw_radius")), *[g(v) for v in values]]
    return ",".join((*_STRAIN_HEAD, *names)), row.select("point_id", F.concat_ws(",", *cells).alias("line"))
