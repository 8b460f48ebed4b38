"""Order and structure: ordinals, gaps, events of several lines, sections, occurrences, overlapping chunks, samples, shapes of
tables, trees and documents, and what these suggest as a plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sedimenta.functions.normalize import primitive
from sedimenta.operators.lines import PLACEHOLDERS
from sedimenta.sources.shared import written

LEVELS = ("TRACE", "DEBUG", "INFO", "NOTICE", "WARN", "WARNING", "ERROR", "CRITICAL", "FATAL")
HEADER_ROWS, MOST_CANDIDATES = 8, 32


def ordinals(df: DataFrame, *order: str, name: str = "ordinal") -> DataFrame:
    """Rows with their place from 0 in a total order, in two steps: places within sorted ranges, plus the ranges before."""
    ranged = written(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    start, starts = 0, []
    for part, n in sorted(ranged.groupBy("_part").count().collect()):  # a row for each range
        starts.append((part, start))
        start += n
    starts = df.sparkSession.createDataFrame(starts, "_part int, _start long")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return ranged.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")  # as many rows as ranges


def gaps(df: DataFrame, within: str, order: str) -> DataFrame:
    """within, after, before: where the numbers of ``order`` are not one more than the ones before them."""
    w = Window.partitionBy(within).orderBy(order)
    return df.select(within, F.lag(order).over(w).alias("after"), F.col(order).alias("before")).where("before <> after + 1")


def occurrences(df: DataFrame, within: list[str], name: str, order: str) -> DataFrame:
    """``occurrence``: how often the name came before in the order, within the same holder."""
    return df.withColumn("occurrence", F.row_number().over(Window.partitionBy(*within, name).orderBy(order)) - 1)


def first_of(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """The first row of each key; minima are combined before the shuffle, so a key that most rows have is no hot group."""
    rest = [c for c in df.columns if c not in key]
    least = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return least.select(*[F.col(c) if c in key else F.col("_first").getField(c).alias(c) for c in df.columns])


def shape_of(line: Column) -> Column:
    """struct(template, shape, times, levels) of a line's first 64 tokens: what varies is named by its kind, a date and a time
    are one, a key keeps its name."""
    tokens = F.slice(F.split(F.regexp_replace(F.trim(line), r"^(\d{4}-\d{2}-\d{2}) (\d{2}:\d{2})", "$1T$2"), r"\s+"), 1, 64)
    level = lambda t: F.regexp_replace(t, r"^[\[\]:]+|[\[\]:]+$", "").isin(*LEVELS)
    key, value = lambda t: F.substring_index(t, "=", 1), lambda t: t.substr(F.instr(t, "=") + 1, F.length(t))
    pair = lambda t: (F.instr(t, "=") > 1) & (value(t) != "") & (F.length(key(t)) <= 128)
    kind = lambda t: primitive(t)
    template = F.transform(tokens, lambda t: F.when(pair(t), F.concat(key(t), F.lit("=<"), kind(value(t)), F.lit(">"))).when(kind(t) != "string", F.concat(F.lit("<"), kind(t), F.lit(">"))).otherwise(t))
    shape = F.transform(tokens, lambda t: F.when(pair(t), "key_value").when(kind(t) != "string", kind(t)).when(level(t), "level").otherwise("word"))
    return F.struct(F.array_join(template, " ").alias("template"), F.array_join(shape, " ").alias("shape"), F.size(F.filter(tokens, lambda t: kind(t) == "timestamp")).alias("times"), F.size(F.filter(tokens, level)).alias("levels"))


def shapes(df: DataFrame, least: int = 2) -> DataFrame:
    """role (template or shape), signature, occurrences, times, levels of signatures that come ``least`` times."""
    found = df.select(shape_of(F.col("line")).alias("s"))
    both = F.array(*[F.struct(F.lit(r).alias("role"), F.col(f"s.{r}").alias("signature")) for r in ("template", "shape")])
    rows = found.select("s.times", "s.levels", F.inline(both))
    out = rows.groupBy("role", "signature").agg(F.count(F.lit(1)).alias("occurrences"), F.sum("times").alias("times"), F.sum("levels").alias("levels"))
    return out.where(F.col("occurrences") >= least)


def multiline(df: DataFrame, within: str = "id", order: str = "line_no") -> DataFrame:
    """within, first, last, signature of what may be events of several lines: a line that is not blank opens one, an indented
    line goes on (indented_continuation), a blank line ends one of several lines (blank_separator); a gap in the numbers
    or a line with a time starts anew."""
    w = Window.partitionBy(within).orderBy(order)
    blank = F.trim("line") == ""
    indented = F.col("line").rlike(r"^\s") & ~blank
    timed = F.col("line").rlike(PLACEHOLDERS[0][0])
    broken = F.coalesce(F.col(order) != F.lag(order).over(w) + 1, F.lit(True))
    marked = df.withColumns({"_blank": blank, "_indented": indented, "_broken": broken, "_timed": timed})
    opens = F.col("_broken") | F.coalesce(F.lag("_blank").over(w), F.lit(False)) | (F.col("_timed") & ~F.col("_indented") & ~F.col("_blank"))
    run = marked.withColumn("_run", F.sum(opens.cast("int")).over(w))
    inside = Window.partitionBy(within, "_run").orderBy(order)
    run = run.withColumn("_first", F.first(F.when(~F.col("_blank"), F.col(order)), ignorenulls=True).over(inside))
    goes_on = run.where(F.col("_indented") & (F.col(order) > F.col("_first"))).select(within, F.col("_first").alias("first"), F.col(order).alias("last"), F.lit("indented_continuation").alias("signature"))
    ends = run.where(F.col("_blank") & (F.col(order) - 1 > F.col("_first"))).select(within, F.col("_first").alias("first"), (F.col(order) - 1).alias("last"), F.lit("blank_separator").alias("signature"))
    return goes_on.union(ends)


def section_labels(df: DataFrame, heading: Column, text: str, within: str = "id", order: str = "line_no") -> DataFrame:
    """``label``: the last heading's text at or before each row."""
    w = Window.partitionBy(within).orderBy(order)
    return df.withColumn("label", F.last(F.when(heading, F.col(text)), ignorenulls=True).over(w))


def chunks(df: DataFrame, budget: int, overlap: int = 1, within: str = "id", order: str = "line_no", text: str = "line") -> DataFrame:
    """within, chunk, first, last, bytes of runs of fragments of ``budget`` bytes at most; a chunk begins with the last
    ``overlap`` fragments of the one before as far as they leave room. A fragment over the budget is a chunk of its own.

    Packing is greedy and in order, so each document is packed in one task; a task holds numbers, not texts.
    """
    import pandas as pd

    sizes = df.select(within, order, F.octet_length(text).alias("bytes"))

    def pack(key, group):
        group = group.sort_values(order)
        places, lengths = group[order].tolist(), group["bytes"].tolist()
        out = []
        first = kept = size = 0  # the chunk begins at ``first``; its fragments from ``kept`` on are new in it
        for i, n in enumerate(lengths):
            if size + n > budget and i > first:
                if i > kept:
                    out.append((first, i, size))
                back = max(first, i - overlap)
                size -= sum(lengths[first:back])
                first, kept = back, i
                while first < i and size + n > budget:
                    size -= lengths[first]
                    first += 1
            size += n
        if len(lengths) > kept:
            out.append((first, len(lengths), size))
        rows = [(key[0], k, places[a], places[b - 1], total) for k, (a, b, total) in enumerate(out)]
        return pd.DataFrame(rows, columns=[within, "chunk", "first", "last", "bytes"])

    kind, place = (df.schema[c].dataType.simpleString() for c in (within, order))
    return sizes.groupBy(within).applyInPandas(pack, f"{within} {kind}, chunk int, first {place}, last {place}, bytes long")


def prefix_and_tail(df: DataFrame, within: str, order: str, head: int = 256, tail: int = 8) -> DataFrame:
    """The first ``head`` and last ``tail`` rows of each holder, once each."""
    up, down = Window.partitionBy(within).orderBy(order), Window.partitionBy(within).orderBy(F.desc(order))
    return df.withColumn("_up", F.row_number().over(up)).withColumn("_down", F.row_number().over(down)).where((F.col("_up") <= head) | (F.col("_down") <= tail)).drop("_up", "_down")


def page(df: DataFrame, order: list[str], offset: int, limit: int) -> DataFrame:
    """``limit`` rows from ``offset`` on in a total order."""
    return df.orderBy(*order).offset(offset).limit(limit)


# ---- tables


def header_candidates(cells: DataFrame) -> DataFrame:
    """row_index, score of rows among the first HEADER_ROWS that may be a header: as wide as most rows, three quarters of
    their cells words; 0.85 where a number stands below in some of its columns, else 0.55."""
    widths = cells.groupBy("row_index").agg(F.count(F.lit(1)).alias("width"))
    most = widths.groupBy("width").agg(F.count(F.lit(1)).alias("n")).agg(F.max_by("width", F.struct("n", "width")).alias("most"))
    kind = primitive(F.trim("value"))
    typed = cells.withColumn("_kind", kind)
    first = typed.where(F.col("row_index") < HEADER_ROWS)
    words = first.groupBy("row_index").agg(F.count_if((F.col("_kind") == "string") & (F.trim("value") != "")).alias("words"), F.count(F.lit(1)).alias("width"), F.collect_set("column_index").alias("columns"))
    numeric = typed.where(F.col("_kind").isin("integer", "decimal", "date", "timestamp")).groupBy("column_index").agg(F.max("row_index").alias("last"))
    full = words.crossJoin(F.broadcast(most)).where("width = most and 4 * words >= 3 * width")  # one row
    below = full.select("row_index", F.explode("columns").alias("column_index")).join(numeric, "column_index", "left")
    out = below.groupBy("row_index").agg(F.max(F.coalesce((F.col("last") > F.col("row_index")).cast("int"), F.lit(0))).alias("contrast"))
    return out.select("row_index", F.when(F.col("contrast") == 1, 0.85).otherwise(0.55).alias("score"))


# ---- trees and documents


def path_statistics(nodes: DataFrame) -> DataFrame:
    """path (array places as *), occurrences, and how many are objects, arrays and scalars; of nodes as ``sources.files`` gives."""
    pattern = F.regexp_replace(F.regexp_replace("path", r"/\d+(?=/|$)", "/*"), r"#\d+", "")
    is_in = lambda *kinds: F.count_if(F.col("kind").isin(*kinds))
    by = nodes.where("kind <> 'malformed'").groupBy(pattern.alias("path"))
    return by.agg(F.count(F.lit(1)).alias("occurrences"), is_in("object").alias("objects"), is_in("array").alias("arrays"), F.count_if(~F.col("kind").isin("object", "array")).alias("scalars"))


def record_roots(nodes: DataFrame) -> DataFrame:
    """path, occurrences, score of paths that hold records: objects in an array, 0.85 where there are several, else 0.8."""
    stats = path_statistics(nodes).where((F.col("objects") > 0) & F.col("path").endswith("/*"))
    return stats.select("path", "occurrences", F.when(F.col("objects") > 1, 0.85).otherwise(0.8).alias("score"))


def ancestor_paths(nodes: DataFrame, depth: int = 30) -> DataFrame:
    """node, root, path, depth of nodes (node, parent, name) by their parents, level by level, ``depth`` at most.

    Nodes whose parent is missing, that are deeper or in a cycle have no path and are left out."""
    level = nodes.where("parent is null").select("node", F.col("node").alias("root"), F.col("name").alias("path"), F.lit(0).alias("depth"))
    out = level = written(level)
    for i in range(1, depth + 1):
        level = written(nodes.alias("n").join(level.alias("l"), F.col("n.parent") == F.col("l.node")).select("n.node", "l.root", F.concat("l.path", F.lit("/"), "n.name").alias("path"), F.lit(i).alias("depth")))
        if level.isEmpty():
            break
        out = out.union(level)
    return out


def chain_faults(nodes: DataFrame, depth: int = 32) -> DataFrame:
    """node, fault of records whose parent does not exist (missing_parent) or whose chain ends in no root (deep_or_cyclic)."""
    known = nodes.select(F.col("node").alias("_k"))
    missing = nodes.where("parent is not null").join(known, F.col("parent") == F.col("_k"), "left_anti").select("node", F.lit("missing_parent").alias("fault"))
    placed = ancestor_paths(nodes.withColumn("name", F.lit("")), depth).select("node")
    below = written(missing.select(F.col("node").alias("node")))
    reached = below
    for _ in range(depth):  # what hangs below a missing parent has no fault of its own
        below = written(nodes.join(below.withColumnRenamed("node", "_p"), F.col("parent") == F.col("_p")).select("node").join(reached, "node", "left_anti"))
        if below.isEmpty():
            break
        reached = reached.union(below)
    lost = nodes.select("node").join(placed, "node", "left_anti").join(reached, "node", "left_anti").select("node", F.lit("deep_or_cyclic").alias("fault"))
    return missing.union(lost)


def repeated_groups(blocks: DataFrame, within: str = "id", section: str = "section_no", order: str = "block_no") -> DataFrame:
    """kinds, sections: sequences of block kinds that several sections have."""
    kinds = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "kind"))), lambda x: x["kind"]), ",")
    return blocks.groupBy(within, section).agg(kinds.alias("kinds")).groupBy("kinds").agg(F.count(F.lit(1)).alias("sections")).where("sections > 1")


def confidence(boundary: Column, regularity: Column, coverage: Column) -> Column:
    """A plan is as sure as its least sure part."""
    return F.least(boundary, regularity, coverage)


def ranked_candidates(df: DataFrame, within: str, most: int = MOST_CANDIDATES) -> DataFrame:
    """Candidates (within, kind, id, confidence) by falling confidence, then kind and id, ``most`` of each holder."""
    w = Window.partitionBy(within).orderBy(F.desc("confidence"), "kind", "id")
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)


def repeats_of_lines(blocks: DataFrame, lines: DataFrame) -> DataFrame:
    """Blocks (id, block_no, first, last, text) whose text is that of their lines, so that one of both is enough.

    A block's range is exploded, so the join is by line and not by range."""
    each = blocks.select("id", "block_no", "text", F.explode(F.sequence("first", "last")).alias("line_no"))
    said = each.join(lines.select("id", "line_no", "line"), ["id", "line_no"]).groupBy("id", "block_no", "text").agg(F.array_sort(F.collect_list(F.struct("line_no", "line"))).alias("_l"))
    whole = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    return said.where(F.col("text") == whole).select("id", "block_no")


def spans_of(df: DataFrame, text: str, spans: str, name: str = "value") -> DataFrame:
    """Exact slices (start, end, sha256) of a text joined by a space; a slice whose hash differs is an error."""
    piece = lambda s: F.col(text).substr(s["start"] + 1, s["end"] - s["start"])
    sure = lambda s: F.when(F.sha2(piece(s), 256) == s["sha256"], piece(s)).otherwise(F.raise_error(F.lit("a slice is not what was said")).cast("string"))
    return df.withColumn(name, F.array_join(F.transform(spans, sure), " "))


def grouped_blocks(df: DataFrame, n: int, order: str = "block_no") -> DataFrame:
    """``record_no`` of n blocks each."""
    return df.withColumn("record_no", F.floor(F.col(order) / n))


def explicit_groups(df: DataFrame, groups: DataFrame, within: str = "id", order: str = "line_no", text: str = "line") -> DataFrame:
    """within, record_no, text of records that list their lines (``groups``: within, record_no, first, last), which must be
    there without gaps; a record that lacks one is an error."""
    each = groups.select(within, "record_no", "first", "last", F.explode(F.sequence("first", "last")).alias(order))
    met = each.join(df.select(within, order, text), [within, order]).groupBy(within, "record_no", "first", "last").agg(F.array_sort(F.collect_list(F.struct(order, text))).alias("_l"))
    whole = F.array_join(F.transform("_l", lambda x: x[text]), "\n")
    sure = F.when(F.size("_l") == F.col("last") - F.col("first") + 1, whole).otherwise(F.raise_error(F.lit("a record lacks a line")).cast("string"))
    return met.select(within, "record_no", sure.alias(text))
