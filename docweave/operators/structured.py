"""Structured-text extractors: XML (S6), CSV and table previews (S7, S8),
notebooks (S9).

Design: a document is one row.  Parsing that Spark cannot express (XML
trees, CSV quoting) happens in Arrow-batched pandas UDFs that return plain
arrays; layout rules (indentation, joins, first-20 cuts) are JVM
expressions.  Nothing is regrouped across rows unless the input really is
one row per record (``table_preview``), and there the first-N cut runs as a
window group limit before the shuffle.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docweave.functions.jsontext import safe_text

# ---- fixed values ----------------------------------------------------------
PREVIEW_ROWS = 20
CELL_SEP = ", "
CODE_CELL_MARK = "# code cell"
# -----------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# S6a / S6b  XML
#: Characters given to a parser at a time, and rows of a batch, at most.
FED = 1 << 16
BATCH = 2_048


class _Ignore:
    """A parser target that keeps nothing: what remains is the check."""

    def close(self):
        return None


def _fed(parser, raw: str):
    for at in range(0, len(raw), FED):
        parser.feed(raw[at:at + FED])
        yield
    parser.close()
    yield


def xml_error(raw: str) -> str | None:
    """Why ``raw`` is no XML document; nothing of it is kept in memory."""
    import xml.etree.ElementTree as ET

    try:
        for _ in _fed(ET.XMLParser(target=_Ignore()), raw):
            pass
    except ET.ParseError as e:
        return f"ParseError: {e}"
    return None


def xml_steps(raw: str):
    """(kind, level, tag, attributes, text) of a well-formed document in order:
    'open', the element's leading text, 'close'.  Elements are let go as they
    end, so memory is that of the open ones; a malformed document raises."""
    import xml.etree.ElementTree as ET

    parser = ET.XMLPullParser(("start", "end"))
    above: list = []  # the open elements; whether their leading text is out

    def leading():
        if above and not above[-1][1]:
            above[-1][1] = True
            el = above[-1][0]
            if el.text and el.text.strip():
                yield "text", len(above) - 1, el.tag, None, el.text.strip()

    for _ in _fed(parser, raw):
        for event, el in parser.read_events():
            yield from leading()
            if event == "start":
                yield "open", len(above), el.tag, el.attrib, None
                above.append([el, False])
            else:
                above.pop()
                yield "close", len(above), el.tag, None, None
                if above:
                    above[-1][0].remove(el)


def xml_elements(df: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """``(*keys, seq, level, kind, tag, attrs map, text)``, a row an element
    part; a malformed document is one ``raw`` row, a null one none.

    A document is checked first and then walked by a pull parser; its rows leave
    in bounded batches, however many elements it has.
    """
    import pyarrow as pa

    keys = list(key_cols)
    schema = pa.schema([("seq", pa.int32()), ("level", pa.int32()), ("kind", pa.string()), ("tag", pa.string()),
                        ("attrs", pa.map_(pa.string(), pa.string())), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            of, rows = [], []  # the documents of the rows, and the rows

            def out():
                parts = zip(*rows)
                columns = [pa.array(list(c), f.type) for c, f in zip(parts, schema)]
                taken = batch.select(keys).take(pa.array(of, pa.int64()))
                return pa.RecordBatch.from_arrays(taken.columns + columns, names=keys + schema.names)

            texts = batch.column(batch.schema.names.index("__xml"))
            for i in range(batch.num_rows):
                raw = texts[i].as_py()
                if raw is None:
                    continue
                bad = xml_error(raw) is not None
                steps = [("raw", 0, None, None, raw)] if bad else xml_steps(raw)
                for seq, (kind, level, tag, attrs, text) in enumerate(steps):
                    of.append(i)
                    rows.append((seq, level, kind, tag, None if attrs is None else list(attrs.items()), text))
                    if len(rows) >= BATCH:
                        yield out()
                        of, rows = [], []
            if rows:
                yield out()

    kept = df.select(*keys, F.col(text_col).alias("__xml"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return kept.mapInArrow(run, f"{key_schema}, seq int, level int, kind string, tag string, attrs map<string,string>, text string")


def xml_outline_one(raw: str | None) -> str | None:
    """S6b of one document; malformed XML is its own outline."""
    import xml.etree.ElementTree as ET

    if raw is None:
        return None
    lines = []
    try:
        for kind, level, tag, attrs, text in xml_steps(raw):
            if kind == "open":
                lines.append("  " * level + "<" + tag + "".join(f' {k}="{v}"' for k, v in attrs.items()) + ">")
            elif kind == "text":
                lines.append("  " * level + "  " + text)
            else:
                lines.append("  " * level + "</" + tag + ">")
    except ET.ParseError:
        return raw
    return "\n".join(lines)


@F.pandas_udf(T.StringType())
def _xml_outline(s: pd.Series) -> pd.Series:
    return pd.Series([xml_outline_one(v) for v in s], dtype=object)


def xml_outline(c) -> Column:
    """Indented outline; malformed XML gives the raw text unchanged."""
    return _xml_outline(_c(c))


# ---------------------------------------------------------------------------
# S7  CSV preview over a CSV text column (one file = one row)
def csv_head(raw, n: int = PREVIEW_ROWS):
    """(preview, error) of one CSV text: its first ``n`` records without empty
    cells.  Fields of any length are read; what the csv module refuses is the
    error of this text alone."""
    import csv
    from io import StringIO
    from itertools import islice

    if raw is None:
        return None, None
    csv.field_size_limit(2 ** 31 - 1)
    try:
        # newline="": the reader itself ends records at \r\n and \r
        records = list(islice(csv.reader(StringIO(raw, newline="")), n))
    except csv.Error as e:
        return None, f"{type(e).__name__}: {e}"
    return "\n".join(CELL_SEP.join(filter(None, cells)) for cells in records), None


def csv_preview_one(raw, n: int = PREVIEW_ROWS):
    return csv_head(raw, n)[0]


@F.pandas_udf(T.StringType())
def _csv_preview(s: pd.Series) -> pd.Series:
    return pd.Series([csv_preview_one(v) for v in s], dtype=object)


def csv_preview(c) -> Column:
    """First 20 CSV records, empty cells dropped, ', ' and newline joins."""
    return _csv_preview(_c(c))


def read_csv_head(file, n: int = PREVIEW_ROWS):
    """(preview, error) of an open binary file, read block by block until its
    first ``n`` records are complete; quoted line breaks are part of a record."""
    import csv
    from io import TextIOWrapper
    from itertools import islice

    csv.field_size_limit(2 ** 31 - 1)
    # newline="": the csv reader itself ends records at \r\n and \r
    text = TextIOWrapper(file, encoding="utf-8", errors="replace", newline="")
    try:
        records = list(islice(csv.reader(text), n))
    except csv.Error as e:
        return None, f"{type(e).__name__}: {e}"
    return safe_text("\n".join(CELL_SEP.join(filter(None, cells)) for cells in records)), None


def csv_file_preview(spark, paths, n: int = PREVIEW_ROWS, glob: str | None = None) -> DataFrame:
    """S7 for CSV files: ``(path, preview, error)`` per file, of any size.

    Spark lists the files (their content is not read); each task opens its files
    one after the other and stops at record ``n``, so a file costs a block or
    two, or its first ``n`` records where those are longer.  A file that cannot
    be opened, or that the csv module refuses, has its error and no preview; a
    file without records has an empty preview.
    """
    from docweave.sources.listing import empty_files

    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return csv_heads(reader.load(paths).select("path").unionByName(empty_files(spark, paths, glob).select("path")), n)


def csv_heads(listed: DataFrame, n: int = PREVIEW_ROWS) -> DataFrame:
    """``(path, preview, error)`` of the CSV files that ``listed`` (path) names."""
    spark = listed.sparkSession
    slots = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def heads(batches):
        from docweave.sources.storage import open_store

        for pdf in batches:
            rows = []
            for path in pdf["path"]:
                try:
                    store, at = open_store(path)
                    with store.open_input_stream(at, buffer_size=1 << 16) as file:
                        rows.append((path, *read_csv_head(file, n)))
                except OSError as e:
                    rows.append((path, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(rows, columns=["path", "preview", "error"])

    return listed.repartition(slots, "path").mapInPandas(heads, "path string, preview string, error string")


# ---------------------------------------------------------------------------
# S8  table preview: first N rows per group, non-empty cells
def _ordered_concat(df: DataFrame, keys, order_col: str, value_col: str, sep: str,
                    out: str) -> DataFrame:
    """Grouped concat in an explicit order (never relies on collect order)."""
    agg = df.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"),
                                             F.col(value_col).alias("v")))).alias("_p"))
    return agg.select(*keys, F.array_join(F.transform("_p", lambda p: p["v"]), sep).alias(out))


def table_preview(df: DataFrame, group_cols, order_cols, cell_cols, n: int = PREVIEW_ROWS,
                  title_col: str | None = None, drop: str = "empty") -> DataFrame:
    """Per group, the first ``n`` rows (by ``order_cols``) as text lines.

    Cells are cast to string; ``drop='empty'`` drops empty strings (CSV rule),
    ``drop='null'`` drops nulls (sheet rule).  With ``title_col`` each preview
    gets a ``Sheet: <title>`` heading.  ``row_number() <= n`` is planned as a
    window group limit, applied map-side before the shuffle, so a hot group
    ships at most ``n`` rows per input split.
    """
    group_cols = list(group_cols)
    if title_col is not None and title_col not in group_cols:
        raise ValueError("title_col must be one of group_cols")
    w = Window.partitionBy(*group_cols).orderBy(*order_cols)
    cells = F.array(*[F.col(c).cast("string") for c in cell_cols])
    keep = (F.filter(cells, lambda x: x != "") if drop == "empty"
            else F.filter(cells, lambda x: x.isNotNull()))
    # rank first, build cells only for the survivors
    ranked = (df.withColumn("_rn", F.row_number().over(w))
                .where(F.col("_rn") <= n)
                .withColumn("_cells", keep))
    lines = ranked.select(*group_cols, "_rn", F.array_join("_cells", CELL_SEP).alias("_line"))
    out = _ordered_concat(lines, group_cols, "_rn", "_line", "\n", "preview")
    if title_col:
        out = out.withColumn("preview", F.concat(F.lit("Sheet: "), F.col(title_col).cast("string"),
                                                 F.lit("\n"), F.col("preview")))
    return out


# ---------------------------------------------------------------------------
# S9  notebooks
_NB_LIST = "struct<cells:array<struct<cell_type:string,source:array<string>>>>"
_NB_STR = "struct<cells:array<struct<cell_type:string,source:string>>>"


#: Notebooks above so many characters are read in Python: the JVM's JSON reader
#: refuses strings that are longer than 20 million.
LARGE_NOTEBOOK = 8_000_000


def notebook_cells_one(raw: str):
    """(cell type, source) of a notebook's cells, blank ones included; ValueError
    where it is no JSON object."""
    import json

    try:
        nb = json.loads(raw)
    except RecursionError as e:
        raise ValueError(str(e)) from e
    if not isinstance(nb, dict):
        raise ValueError("notebook is not a JSON object")
    plain = lambda x: x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    cells = nb.get("cells")
    for cell in cells if isinstance(cells, list) else ():
        source = cell.get("source") if isinstance(cell, dict) else None
        kind = cell.get("cell_type") if isinstance(cell, dict) else None
        if isinstance(source, list):
            source = "".join(plain(x) for x in source if x is not None)
        yield (None if kind is None else plain(kind)), ("" if source is None else plain(source))


def notebook_text_one(raw: str | None):
    """(text, error) of one notebook."""
    if raw is None:
        return None, None
    try:
        parts = [[CODE_CELL_MARK, s] if kind == "code" else [s] for kind, s in notebook_cells_one(raw) if s.strip()]
    except ValueError as e:
        return None, safe_text(str(e))
    return safe_text("\n\n".join(x for p in parts for x in p)), None


@F.pandas_udf(T.StringType())
def _large_notebook(s: pd.Series) -> pd.Series:
    return pd.Series([notebook_text_one(v)[0] for v in s], dtype=object)


def notebook_cells(df: DataFrame, text_col: str = "text", key_cols=("doc_id",)) -> DataFrame:
    """S9 as rows: ``(*keys, cell_no, cell_type, text)`` of the non-blank cells,
    in bounded batches; cells keep the numbers they have in the notebook.  What
    is no notebook has no rows."""
    import pyarrow as pa

    keys = list(key_cols)
    schema = pa.schema([("cell_no", pa.int32()), ("cell_type", pa.string()), ("text", pa.string())])

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.names.index("__nb"))
            for i in range(batch.num_rows):
                raw, rows, size = texts[i].as_py(), [], 0
                if raw is None:
                    continue
                try:
                    cells = list(notebook_cells_one(raw))
                except ValueError:
                    continue
                del raw
                for n, (kind, source) in enumerate(cells):
                    if source.strip():
                        rows.append((n, kind, safe_text(source)))
                        size += len(source)
                    if rows and (len(rows) >= BATCH or size >= 1 << 22 or n == len(cells) - 1):
                        columns = [pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)]
                        taken = batch.select(keys).take(pa.array([i] * len(rows), pa.int64()))
                        yield pa.RecordBatch.from_arrays(taken.columns + columns, names=keys + schema.names)
                        rows, size = [], 0

    kept = df.select(*keys, F.col(text_col).alias("__nb"))
    key_schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema.fields)
    return kept.mapInArrow(run, f"{key_schema}, cell_no int, cell_type string, text string")


def notebook_text(c) -> Column:
    """Non-blank cells; code cells preceded by '# code cell'; blank-line join.

    A notebook of ordinary size stays in the JVM (``_notebook_text``), a large
    one is read in Python; the rule is the same.
    """
    col = _c(c)
    large = F.char_length(col) > LARGE_NOTEBOOK
    return F.when(large, _large_notebook(F.when(large, col))).otherwise(_notebook_text(F.when(~large, col)))


def _notebook_text(col: Column) -> Column:
    """A cell's source may be a list of strings or one string: the JSON is read
    under both schemas and the non-null reading is used."""
    as_list = F.from_json(col, _NB_LIST)["cells"]
    as_str = F.from_json(col, _NB_STR)["cells"]
    cells = F.zip_with(as_list, as_str, lambda a, b: F.struct(
        a["cell_type"].alias("t"),
        F.coalesce(F.array_join(a["source"], ""), b["source"], F.lit("")).alias("s")))
    visible = F.filter(cells, lambda x: F.regexp_replace(x["s"], r"(?U)[\s\x1c-\x1f]+", "") != "")
    parts = F.transform(visible, lambda x: F.when(
        x["t"] == "code", F.array(F.lit(CODE_CELL_MARK), x["s"])).otherwise(F.array(x["s"])))
    return F.coalesce(F.array_join(F.flatten(parts), "\n\n"), F.lit(""))
