"""Files as rows: physical lines with their ends, encodings, delimited cells with ragged rows, nodes of JSON, XML and HTML."""

from __future__ import annotations

import csv
import io
import json
from collections import Counter
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sedimenta.sources.shared import written

#: Elements whose content acts rather than says; they and what they hold are marked. Elements that hold nothing.
ACTIVE = frozenset("script style iframe object embed template svg math".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_NODE = "path string, parent string, kind string, name string, value string, occurrence int"


def physical_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line_no (from 0), line, terminator of text files of any size.

    Lines end with CR, LF or CRLF; the last may have no end. Files are read in splits: a line's number is its place in
    its split plus the lines of the splits before, of which only the counts are gathered by file.
    """
    meta = F.col("_metadata")
    rows = spark.read.option("lineSep", "\n").text(path).select(meta["file_path"].alias("path"), meta["file_block_start"].alias("block"), meta["file_size"].alias("size"), "value", F.monotonically_increasing_id().alias("seq"))
    rows = rows.withColumn("last_cr", F.col("value").endswith("\r"))
    body = F.when(F.col("last_cr"), F.expr("substr(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    rows = rows.select("path", "block", "size", "seq", "last_cr", F.octet_length("value").alias("bytes"), F.split(body, "\r", -1).alias("parts"))
    rows = written(rows)
    sums = rows.groupBy("path", "block").agg(F.sum(F.size("parts")).alias("n"), F.sum(F.col("bytes") + 1).alias("bytes"))
    before = Window.partitionBy("path").orderBy("block")
    starts = sums.select("path", "block", (F.sum("n").over(before) - F.col("n")).alias("start"), F.sum("bytes").over(before).alias("upto"), F.max("block").over(Window.partitionBy("path")).alias("last_block"))
    inside = Window.partitionBy("path", "block").orderBy("seq")
    placed = rows.withColumn("own", F.sum(F.size("parts")).over(inside) - F.size("parts")).withColumn("last_seq", F.max("seq").over(Window.partitionBy("path", "block")))
    placed = placed.join(starts, ["path", "block"])
    # the reader takes the end for granted: in the last row of a file it is there if the bytes add up to the size
    ended = ~((F.col("block") == F.col("last_block")) & (F.col("seq") == F.col("last_seq")) & (F.col("upto") > F.col("size")))
    out = placed.select("path", (F.col("start") + F.col("own")).alias("first"), "last_cr", ended.alias("ended"), F.size("parts").alias("n"), F.posexplode("parts").alias("at", "line"))
    last = F.col("at") == F.col("n") - 1
    end = F.when(~last, "\r").when(F.col("last_cr") & F.col("ended"), "\r\n").when(F.col("last_cr"), "\r").when(F.col("ended"), "\n").otherwise("")
    return out.select("path", (F.col("first") + F.col("at")).alias("line_no"), "line", end.alias("terminator"))


def encoding_of(content: Column) -> Column:
    """The encoding of bytes by their mark, else utf-8 where they are valid, else null: bytes are never replaced."""
    head = F.hex(F.substring(content, 1, 4))
    mark = F.when(head.startswith("EFBBBF"), "utf-8-sig").when(head.isin("0000FEFF"), "utf-32-be").when(head == "FFFE0000", "utf-32-le").when(head.startswith("FEFF"), "utf-16-be").when(head.startswith("FFFE"), "utf-16-le")
    return F.coalesce(mark, F.when(F.is_valid_utf8(content.cast("string")), "utf-8"))


def artifacts(spark: SparkSession, path: str, most_bytes: int | None = None) -> DataFrame:
    """path, length, sha256 and encoding of raw files; a file over ``most_bytes`` is an error that names it."""
    files = spark.read.format("binaryFile").load(path)
    content = F.col("content")
    if most_bytes is not None:
        content = F.when(F.col("length") <= most_bytes, content).otherwise(F.raise_error(F.concat(F.lit("file too large: "), "path")).cast("binary"))
    return files.select("path", "length", F.sha2(content, 256).alias("sha256"), encoding_of(content).alias("encoding"))


def delimited_cells(texts: DataFrame, key: str, text: str, delimiter: str = ",", quote: str = '"', escape: str | None = None) -> DataFrame:
    """key, row_index, column_index, value, width of delimited texts: raw cells, rows as wide as they are, line ends within
    quotes kept. A quote that is never closed is an error. Blank lines are no rows."""

    def cut(batches):
        import pyarrow as pa

        for b in batches:
            out = {"key": [], "row_index": [], "column_index": [], "value": [], "width": []}
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader = csv.reader(io.StringIO(t or "", newline=""), delimiter=delimiter, quotechar=quote, escapechar=escape, doublequote=escape is None, strict=True)
                for i, row in enumerate(r for r in reader if r):
                    for j, value in enumerate(row):
                        for name, v in zip(out, (k, i, j, value, len(row)), strict=True):
                            out[name].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out["key"], b.schema.field(0).type), pa.array(out["row_index"], pa.int32()), pa.array(out["column_index"], pa.int32()), pa.array(out["value"], pa.string()), pa.array(out["width"], pa.int32())], names=list(out))

    kind = texts.schema[key].dataType.simpleString()
    return texts.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(cut, f"key {kind}, row_index int, column_index int, value string, width int")


# ---- trees


def _json_nodes(text: str):
    """Nodes of a JSON document in preorder. Keys that repeat are told apart by their occurrence; numbers stay as written."""

    class Pairs(list):
        pass

    class Number(str):
        pass

    def bad(x):
        raise ValueError(x)

    tree = json.loads(text, object_pairs_hook=Pairs, parse_int=Number, parse_float=Number, parse_constant=bad)

    def walk(value, path, parent, name, occurrence):
        if isinstance(value, Pairs):
            yield path, parent, "object", name, None, occurrence
            seen: Counter = Counter()
            for k, v in value:
                step = k.replace("~", "~0").replace("/", "~1")
                yield from walk(v, f"{path}/{step}" + (f"#{seen[k]}" if seen[k] else ""), path, k, seen[k])
                seen[k] += 1
        elif isinstance(value, list):
            yield path, parent, "array", name, None, occurrence
            for i, v in enumerate(value):
                yield from walk(v, f"{path}/{i}", path, None, 0)
        elif isinstance(value, Number):
            yield path, parent, "decimal" if any(c in value for c in ".eE") else "integer", name, str(value), occurrence
        else:
            kind = "null" if value is None else "boolean" if isinstance(value, bool) else "string"
            yield path, parent, kind, name, None if value is None else value if isinstance(value, str) else str(value).lower(), occurrence

    return list(walk(tree, "", None, None, 0))


def _xml_nodes(text: str):
    """Nodes of an XML document: elements, attributes and texts by their paths; documents with a type or entities of their
    own are refused."""
    from xml.parsers import expat

    out, stack, counts = [], [("", Counter())], []
    parser = expat.ParserCreate(namespace_separator=" ")
    parser.buffer_text = True

    def refuse(*_):
        raise ValueError("a document type or entity")

    def start(name, attributes):
        path, seen = stack[-1]
        own = name.rpartition(" ")[2]
        seen[own] += 1
        here = f"{path}/{own}[{seen[own]}]"
        out.append((here, path or None, "element", name, None, seen[own] - 1))
        out.extend((f"{here}/@{k.rpartition(' ')[2]}", here, "attribute", k, v, 0) for k, v in attributes.items())
        stack.append((here, Counter()))

    def said(data):
        path, seen = stack[-1]
        if data.strip():
            seen["text()"] += 1
            out.append((f"{path}/text()[{seen['text()']}]", path, "text", None, data, seen["text()"] - 1))

    parser.StartDoctypeDeclHandler = parser.EntityDeclHandler = parser.ExternalEntityRefHandler = refuse
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, lambda _: stack.pop(), said
    parser.Parse(text.encode("utf-8"), True)
    return out


class _Html(HTMLParser):
    """Elements, attributes and texts of a page as it was written; what is active is marked, with all it holds."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.stack = [], [("", "", Counter(), False)]

    def handle_starttag(self, tag, attrs):
        path, _, seen, active = self.stack[-1]
        seen["*"] += 1
        here, active = f"{path}/{tag}:nth-child({seen['*']})", active or tag in ACTIVE
        self.out.append((here, path or None, "active" if active else "element", tag, None, 0))
        self.out += [(f"{here}/@{k}", here, "attribute", k, v, 0) for k, v in attrs]
        if tag not in VOID:
            self.stack.append((here, tag, Counter(), active))

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.stack.pop()

    def handle_endtag(self, tag):
        for i in range(len(self.stack) - 1, 0, -1):
            if self.stack[i][1] == tag:
                del self.stack[i:]
                return

    def handle_data(self, data):
        path, _, seen, active = self.stack[-1]
        if data.strip():
            seen["text()"] += 1
            self.out.append((f"{path}/text()[{seen['text()']}]", path or None, "active" if active else "text", None, data, seen["text()"] - 1))


def _html_nodes(text: str):
    parser = _Html()
    parser.feed(text)
    parser.close()
    return parser.out


READERS = {"json": _json_nodes, "xml": _xml_nodes, "html": _html_nodes}


def nodes(docs: DataFrame, key: str, text: str, form: str) -> DataFrame:
    """key, ordinal and nodes (path, parent, kind, name, value, occurrence) of JSON, XML or HTML texts, in document order.

    A text that is none has one node of kind ``malformed`` with the reason; a null text has none. A document is read in
    one task, as a whole; documents are read side by side.
    """
    read = READERS[form]
    kind = docs.schema[key].dataType.simpleString()

    def run(frames):
        for f in frames:
            rows = []
            for k, t in zip(f["key"], f["text"], strict=True):
                if t is None:
                    continue
                try:
                    found = read(t)
                except (ValueError, RecursionError, SyntaxError) as e:
                    found = [("", None, "malformed", None, type(e).__name__, 0)]
                except Exception as e:  # the XML reader's own error is no ValueError
                    if type(e).__name__ != "ExpatError":
                        raise
                    found = [("", None, "malformed", None, "ExpatError", 0)]
                rows += [(k, i, *n) for i, n in enumerate(found)]
            yield pd.DataFrame(rows, columns=["key", "ordinal", "path", "parent", "kind", "name", "value", "occurrence"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInPandas(run, f"key {kind}, ordinal int, {_NODE}")
