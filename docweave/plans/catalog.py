"""Registered queries: name -> (Spark builder, DuckDB oracle SQL).

Every builder takes ``(spark, sf_dir)``, reads the supplied Parquet tables
(whole tables, whole texts) and returns a lazy DataFrame.  Column names and
types are aliased to match the oracle SQL exactly.

Sections (in file order):
  T1-T8, S2     text rules over `documents`; routing/titles over `pages.url`
  S4a/S4b, S5   HTML over `pages`; JSON over `events.props`
  S6            XML documents built from `orders` rows
  S7-S9         CSV text, table previews over `events`, notebooks from `conversations`
  A1-A4         assembly over `conversations`, `documents`, `orders`
  P1-P5, M1-M4, O1-O2
                requests derived from `orders` (each order = one request for
                document o_custkey), prompts, batch inference, output
  G1, M5        the supplied tables seen as files; the end-to-end summarize plan
  S1, S3, U1, S7 files, O3
                files written by Spark from the tables, read back
  streaming     the same rules on streaming file sources
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as T
from docweave.session import table
from docweave.sources import formats as FMT

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle.strip()
        return fn
    return deco


# ---------------------------------------------------------------------------
# DuckDB building blocks for the oracles (RE2 has no look-behind, so a
# sentence break is marked with chr(1) and split on it).
def _d_norm(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def _d_sentences(norm: str) -> str:
    return (f"list_filter(string_split(regexp_replace({norm}, '([.!?]) ', '\\1' || chr(1), 'g'),"
            f" chr(1)), lambda s: s <> '')")


def _d_lead(x: str, n) -> str:
    """Lead sentences in DuckDB; ``n`` is a number or an SQL expression."""
    norm = _d_norm(x)
    return (f"CASE WHEN {x} IS NULL OR {norm} = '' THEN '{T.PLACEHOLDER}' "
            f"ELSE array_to_string(list_slice({_d_sentences(norm)}, 1, {n}), ' ') END")


def _d_chunks(x: str, size: int = T.CHUNK_SIZE) -> str:
    return (f"list_transform(generate_series(1, length({x}), {size}), "
            f"lambda i: substring({x}, i, {size}))")


# ---------------------------------------------------------------------------
# Text rules over `documents`

@register("local_summary", f"""
SELECT doc_id,
       array_to_string(list_transform({_d_chunks('text')}, lambda c: {_d_lead('c', 2)}),
                       chr(10) || chr(10)) AS summary
FROM documents
""")
def q_local_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.local_summary("text").alias("summary"))


@register("normalize_whitespace", f"""
SELECT doc_id, {_d_norm('text')} AS text_norm FROM documents
""")
def q_normalize(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.normalize_whitespace("text").alias("text_norm"))


@register("split_sentences", f"""
SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS INTEGER) AS pos, unnest(s) AS sentence
FROM (SELECT doc_id, {_d_sentences(_d_norm('text'))} AS s FROM documents)
""")
def q_split_sentences(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(T.split_sentences("text")).alias("pos", "sentence"))


@register("lead_summary", f"""
SELECT doc_id, {_d_lead('text', T.DEFAULT_SENTENCES)} AS summary FROM documents
""")
def q_lead_summary(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", T.lead_summary("text").alias("summary"))


@register("chunk_text", f"""
SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_no, unnest(c) AS chunk
FROM (SELECT doc_id, {_d_chunks('text')} AS c FROM documents)
""")
def q_chunk_text(spark, sf_dir):
    return T.chunk_rows(table(spark, sf_dir, "documents"))


@register("chunk_summary", f"""
SELECT doc_id, chunk_no, {_d_lead('chunk', 2)} AS chunk_summary
FROM (SELECT doc_id, CAST(generate_subscripts(c, 1) - 1 AS INTEGER) AS chunk_no, unnest(c) AS chunk
      FROM (SELECT doc_id, {_d_chunks('text')} AS c FROM documents))
""")
def q_chunk_summary(spark, sf_dir):
    chunks = T.chunk_rows(table(spark, sf_dir, "documents"))
    return chunks.select("doc_id", "chunk_no", T.chunk_summary("chunk").alias("chunk_summary"))


@register("local_summary_rows", f"""
SELECT doc_id,
       array_to_string(list_transform({_d_chunks('text')}, lambda c: {_d_lead('c', 2)}),
                       chr(10) || chr(10)) AS summary
FROM documents
""")
def q_local_summary_rows(spark, sf_dir):
    # row form of T6: chunks spread across tasks, one small ordered concat
    chunks = T.all_chunk_rows(table(spark, sf_dir, "documents"))
    return T.summaries_from_chunk_rows(chunks)


# S2 + T7 over page URLs: query string and fragment cut, last segment is the name
_D_URL_NAME = "regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)$', 1)"
_D_SUFFIX = f"regexp_extract({_D_URL_NAME}, '^.+(\\.[^.]+)$', 1)"


@register("shorten_title", f"""
SELECT page_id,
       translate(substring({_D_URL_NAME}, 1, length({_D_URL_NAME}) - length({_D_SUFFIX})), '_-', '  ')
         AS title
FROM pages
""")
def q_shorten_title(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    named = pages.select("page_id", FMT.file_name(F.regexp_replace("url", "[?#].*$", "")).alias("name"))
    return named.select("page_id", T.shorten_title(FMT.stem("name")).alias("title"))


def _d_formats_values() -> str:
    rows = ", ".join(f"('{e}', '{k}', {str(h).lower()})" for e, k, h in FMT.FORMATS)
    return f"(VALUES {rows}) AS f(ext, kind, has_extractor)"


def _d_hint_case() -> str:
    parts = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in FMT.MISSING_DEPENDENCY_HINT.items())
    return f"CASE kind {parts} END"


@register("route_by_extension", f"""
SELECT page_id, name, ext, kind,
       CASE WHEN kind IS NULL THEN 'unsupported_type'
            WHEN NOT has_extractor THEN 'missing_dependency' END AS error_class,
       CASE WHEN kind IS NULL THEN 'Unsupported file type: ' || suffix || '. Supported: {FMT.supported_list()}'
            WHEN NOT has_extractor THEN {_d_hint_case()} END AS error
FROM (SELECT page_id, {_D_URL_NAME} AS name, {_D_SUFFIX} AS suffix, lower({_D_SUFFIX}) AS ext
      FROM pages) p
LEFT JOIN {_d_formats_values()} USING (ext)
""")
def q_route(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_replace("url", "[?#].*$", "").alias("path"))
    routed = FMT.route_by_extension(pages, "path")
    return routed.select("page_id", "name", "ext", "kind", "error_class", "error")


@register("level_label", """
SELECT o_orderkey AS req_id, CAST(o_orderkey % 5 AS INTEGER) AS level,
       CASE WHEN o_orderkey % 5 = 1 THEN 'brief' WHEN o_orderkey % 5 = 2 THEN 'detailed'
            ELSE 'full' END AS label
FROM orders
""")
def q_level_label(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    lv = (F.col("o_orderkey") % 5).cast("int")
    return orders.select(F.col("o_orderkey").alias("req_id"), lv.alias("level"),
                         T.level_label(lv).alias("label"))


# ---------------------------------------------------------------------------
# HTML over `pages`
# (the oracle decodes the references present in the supplied pages; &amp; last)
def _d_unescape(x: str) -> str:
    for ent, ch in (("&quot;", "'\"'"), ("&copy;", "chr(169)"), ("&middot;", "chr(183)"),
                    ("&lt;", "'<'"), ("&gt;", "'>'"), ("&#39;", "''''"), ("&nbsp;", "chr(160)")):
        x = f"replace({x}, '{ent}', {ch})"
    # HTML5 also decodes a bare "&amp" (no ';') before a non-name character,
    # and the pages hold that form; then the regular "&amp;"
    x = f"regexp_replace({x}, '&amp([^a-zA-Z0-9;]|$)', '&\\1', 'g')"
    return f"replace({x}, '&amp;', '&')"


_D_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160)"


@register("html_strip_tags", """
SELECT page_id,
       regexp_replace(regexp_replace(regexp_replace(html, '(?i)<script[\\s\\S]*?</script>', '', 'g'),
                                     '(?i)<style[\\s\\S]*?</style>', '', 'g'),
                      '<[^>]+>', '', 'g') AS text
FROM pages
""")
def q_html_strip_tags(spark, sf_dir):
    from docweave.functions.html import html_strip_tags
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html_strip_tags("html").alias("text"))


_D_MARKED = ("regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, "
             "'(?i)<script\\b[^>]*>[\\s\\S]*?</script\\s*>', chr(1), 'g'), "
             "'(?i)<style\\b[^>]*>[\\s\\S]*?</style\\s*>', chr(1), 'g'), "
             "'<!--[\\s\\S]*?-->', chr(1), 'g'), '<[!?][^>]*>', chr(1), 'g')")
_D_MARKED = f"regexp_replace({_D_MARKED}, '</?[A-Za-z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>', chr(1), 'g')"


@register("html_visible_text", f"""
SELECT page_id,
       array_to_string(list_filter(list_transform(string_split({_d_unescape(_D_MARKED)}, chr(1)),
                                                  lambda n: trim(n, {_D_WS})),
                                   lambda n: n <> ''), chr(10)) AS text
FROM pages
""")
def q_html_visible_text(spark, sf_dir):
    from docweave.functions.html import html_visible_text
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", html_visible_text("html").alias("text"))


# JSON pretty printing over events.props (always {"k": <int>})
@register("json_pretty", """
SELECT event_id, '{' || chr(10) || '  "k": ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR)
                 || chr(10) || '}' AS text,
       CAST(NULL AS VARCHAR) AS error
FROM events
""")
def q_json_pretty(spark, sf_dir):
    from docweave.functions.jsontext import json_pretty
    ev = table(spark, sf_dir, "events")
    return ev.select("event_id", json_pretty("props").alias("p")).select("event_id", "p.text", "p.error")


# ---------------------------------------------------------------------------
# One XML document per `orders` row (grows with the data).  Keys with
# o_orderkey % 5 = 3 get an unclosed <broken> element (malformed: the raw text
# is kept), keys with o_orderkey % 4 = 0 have no <note>; the tail text after
# </priority> is dropped by the outline rule.
def _xml_doc_spark(o):
    k = o.o_orderkey
    return F.concat(
        F.lit('<order key="'), k.cast("string"), F.lit('" status="'), o.o_orderstatus,
        F.lit('"><priority> '), o.o_orderpriority, F.lit(" </priority> and more"),
        F.when(k % 4 == 0, F.lit("")).otherwise(F.lit("<note>ok</note>")),
        F.when(k % 5 == 3, F.lit("<broken>")).otherwise(F.lit("")),
        F.lit("</order>"))


_D_XML = ("'<order key=\"' || o_orderkey || '\" status=\"' || o_orderstatus || '\"><priority> ' || "
          "o_orderpriority || ' </priority> and more' || CASE WHEN o_orderkey % 4 = 0 THEN '' "
          "ELSE '<note>ok</note>' END || CASE WHEN o_orderkey % 5 = 3 THEN '<broken>' ELSE '' END || "
          "'</order>'")
_D_XML_OUTLINE = f"""CASE WHEN o_orderkey % 5 = 3 THEN {_D_XML}
  ELSE '<order key="' || o_orderkey || '" status="' || o_orderstatus || '">' || chr(10)
       || '  <priority>' || chr(10) || '    ' || trim(o_orderpriority) || chr(10) || '  </priority>'
       || CASE WHEN o_orderkey % 4 = 0 THEN ''
               ELSE chr(10) || '  <note>' || chr(10) || '    ok' || chr(10) || '  </note>' END
       || chr(10) || '</order>' END"""


@register("xml_outline", f"""
SELECT o_orderkey AS doc_id, {_D_XML_OUTLINE} AS outline FROM orders
""")
def q_xml_outline(spark, sf_dir):
    from docweave.operators.structured import xml_outline
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("doc_id"), xml_outline(_xml_doc_spark(o)).alias("outline"))


# element rows of a valid order document; the <note> rows exist only when
# o_orderkey % 4 <> 0, otherwise the closing </order> moves from seq 7 to 4
@register("xml_elements", f"""
SELECT o_orderkey AS doc_id, CAST(0 AS INTEGER) AS seq, CAST(0 AS INTEGER) AS level, 'raw' AS kind,
       CAST(NULL AS VARCHAR) AS tag, CAST(NULL AS VARCHAR) AS attrs, {_D_XML} AS text
FROM orders WHERE o_orderkey % 5 = 3
UNION ALL
SELECT o_orderkey,
       CAST(CASE WHEN o_orderkey % 4 = 0 AND e.seq = 7 THEN 4 ELSE e.seq END AS INTEGER),
       CAST(e.level AS INTEGER), e.kind, e.tag, e.attrs,
       CASE WHEN e.text = 'PRIORITY' THEN trim(o_orderpriority) ELSE e.text END
FROM orders, (VALUES
    (0, 0, 'open', 'order', 'key,status', NULL),
    (1, 1, 'open', 'priority', '', NULL),
    (2, 1, 'text', 'priority', NULL, 'PRIORITY'),
    (3, 1, 'close', 'priority', NULL, NULL),
    (4, 1, 'open', 'note', '', NULL),
    (5, 1, 'text', 'note', NULL, 'ok'),
    (6, 1, 'close', 'note', NULL, NULL),
    (7, 0, 'close', 'order', NULL, NULL)) AS e(seq, level, kind, tag, attrs, text)
WHERE o_orderkey % 5 <> 3 AND (o_orderkey % 4 <> 0 OR e.seq NOT IN (4, 5, 6))
""")
def q_xml_elements(spark, sf_dir):
    from docweave.operators.structured import xml_elements
    o = table(spark, sf_dir, "orders")
    docs = o.select(F.col("o_orderkey").alias("doc_id"), _xml_doc_spark(o).alias("text"))
    el = xml_elements(docs)
    return el.select("doc_id", "seq", "level", "kind", "tag",
                     F.array_join(F.array_sort(F.map_keys("attrs")), ",").alias("attrs"), "text")


# Every document read as a CSV file (records = lines, cells = commas)
@register("csv_preview", """
SELECT doc_id,
  array_to_string(list_transform(
      list_slice(CASE WHEN suffix(text, chr(10)) THEN list_slice(string_split(text, chr(10)), 1, -2)
                      ELSE string_split(text, chr(10)) END, 1, 20),
      lambda l: array_to_string(list_filter(string_split(l, ','), lambda c: c <> ''), ', ')),
    chr(10)) AS preview
FROM documents
""")
def q_csv_preview(spark, sf_dir):
    from docweave.operators.structured import csv_preview
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", csv_preview("text").alias("preview"))


# First 20 events of every user as CSV-style lines
@register("table_preview", """
SELECT user_id, string_agg(line, chr(10) ORDER BY rn) AS preview
FROM (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn,
             array_to_string(list_filter([CAST(event_id AS VARCHAR), event_type, props],
                                         lambda c: c <> ''), ', ') AS line
      FROM events) t
WHERE rn <= 20 GROUP BY user_id
""")
def q_table_preview(spark, sf_dir):
    from docweave.operators.structured import table_preview
    ev = table(spark, sf_dir, "events", spread_by=["user_id"])
    return table_preview(ev, ["user_id"], ["event_id"], ["event_id", "event_type", "props"])


# One notebook per conversation turn: each line of the text is a cell,
# every third line a code cell, sources alternate list and string form
def _nb_json_spark(text):
    lines = F.split(text, "\n")
    cell = lambda ln, i: F.when(
        i % 2 == 0,
        F.to_json(F.struct(F.when(i % 3 == 0, F.lit("code")).otherwise(F.lit("markdown")).alias("cell_type"),
                           F.array(ln, F.lit("\n")).alias("source"))))\
        .otherwise(F.to_json(F.struct(F.when(i % 3 == 0, F.lit("code")).otherwise(F.lit("markdown")).alias("cell_type"),
                                      ln.alias("source"))))
    return F.concat(F.lit('{"cells": ['), F.array_join(F.transform(lines, cell), ", "), F.lit("]}"))


@register("notebook_text", r"""
SELECT conv_id, turn,
  COALESCE(array_to_string(flatten(list_transform(
      list_filter(list_transform(string_split(text, chr(10)),
                                 lambda l, i: {'t': CASE WHEN (i - 1) % 3 = 0 THEN 'code' ELSE 'markdown' END,
                                               's': CASE WHEN (i - 1) % 2 = 0 THEN l || chr(10) ELSE l END}),
                  lambda c: trim(c.s, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
      lambda c: CASE WHEN c.t = 'code' THEN ['# code cell', c.s] ELSE [c.s] END)),
    chr(10) || chr(10)), '') AS text
FROM conversations
""")
def q_notebook_text(spark, sf_dir):
    from docweave.operators.structured import notebook_text
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", notebook_text(_nb_json_spark(F.col("text"))).alias("text"))


# ---------------------------------------------------------------------------
# A1-A4: assembly
@register("assemble_paragraphs", r"""
SELECT conv_id AS doc_id,
       COALESCE(string_agg(text, chr(10) || chr(10) ORDER BY turn)
                  FILTER (WHERE trim(text, ' ' || chr(9) || chr(10) || chr(13)) <> ''), '') AS text
FROM conversations GROUP BY conv_id
""")
def q_assemble_paragraphs(spark, sf_dir):
    from docweave.operators.assemble import assemble_paragraphs
    conv = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), F.col("turn").alias("part_no"), "text")
    return assemble_paragraphs(conv)


@register("assemble_slides", f"""
SELECT conv_id AS doc_id,
       COALESCE(string_agg('Slide ' || (turn + 1) || ': ' || array_to_string(s, chr(10)),
                           chr(10) || chr(10) ORDER BY turn) FILTER (WHERE len(s) > 0), '') AS text
FROM (SELECT conv_id, turn, {_d_sentences(_d_norm('text'))} AS s FROM conversations) t
GROUP BY conv_id
""")
def q_assemble_slides(spark, sf_dir):
    # slide = turn (numbered from 1), shapes = the turn's sentences
    from docweave.operators.assemble import assemble_slides
    conv = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("slide_no"),
        T.split_sentences("text").alias("shapes"))
    return assemble_slides(conv)


@register("assemble_slides_rows", ORACLES["assemble_slides"])
def q_assemble_slides_rows(spark, sf_dir):
    # two-level form: one row per shape (a sentence of the turn), grouped into
    # slides and then into the document; same result as the in-row form
    from docweave.operators.assemble import assemble_slides_from_shapes
    conv = table(spark, sf_dir, "conversations", spread_by=["conv_id"])
    shapes = conv.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 1).alias("slide_no"),
                         F.posexplode_outer(T.split_sentences("text")).alias("shape_no", "text"))
    return assemble_slides_from_shapes(shapes)


@register("assemble_pages", r"""
SELECT doc_id,
       array_to_string(list_filter(string_split(text, chr(10)),
                                   lambda p: trim(p, ' ' || chr(9) || chr(13)) <> ''),
                       chr(10) || chr(10)) AS text
FROM documents
""")
def q_assemble_pages(spark, sf_dir):
    # pages = the lines of each document, kept inside the row (no shuffle)
    from docweave.operators.assemble import join_parts
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", join_parts(F.split("text", "\n")).alias("text"))


@register("assemble_pages_rows", ORACLES["assemble_pages"])
def q_assemble_pages_rows(spark, sf_dir):
    # grouped form: one row per page (a line of the document), blank pages
    # skipped, ordered concat per document; same result as the in-row form
    from docweave.operators.assemble import assemble_pages
    docs = table(spark, sf_dir, "documents")
    pages = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("page_no", "text"))
    return assemble_pages(pages)


@register("assemble_sheets", """
SELECT doc_id, string_agg(preview, chr(10) || chr(10) ORDER BY sheet) AS text
FROM (SELECT doc_id, sheet, 'Sheet: ' || sheet || chr(10) || string_agg(line, chr(10) ORDER BY rn) AS preview
      FROM (SELECT o_custkey AS doc_id, o_orderstatus AS sheet,
                   row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) AS rn,
                   array_to_string([CAST(o_orderkey AS VARCHAR), o_orderpriority], ', ') AS line
            FROM orders) r
      WHERE rn <= 20 GROUP BY doc_id, sheet) s
GROUP BY doc_id
""")
def q_assemble_sheets(spark, sf_dir):
    # workbook = customer, sheet = order status, rows = orders by key
    from docweave.operators.assemble import assemble_sheets
    o = table(spark, sf_dir, "orders", spread_by=["o_custkey"]).select(
        F.col("o_custkey").alias("doc_id"), F.col("o_orderstatus").alias("sheet"),
        F.col("o_orderstatus").alias("sheet_no"), "o_orderkey", "o_orderpriority")
    return assemble_sheets(o, ["doc_id"], "sheet", "sheet_no", ["o_orderkey"],
                           ["o_orderkey", "o_orderpriority"])


# ---------------------------------------------------------------------------
# Requests derived from `orders` (see requests_from_orders)
from docweave.operators import inference as M  # noqa: E402
from docweave.operators import requests as R  # noqa: E402


def _sq(s: str) -> str:
    """A SQL string literal (newlines as chr(10))."""
    parts = [("'" + p.replace("'", "''") + "'") for p in s.split("\n")]
    return " || chr(10) || ".join(parts)


_D_REQ = """(SELECT o_orderkey AS req_id, o_custkey AS doc_id, (o_orderkey % 4 <> 0) AS use_model,
  CAST(CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 300 - 20 END AS INTEGER) AS sentences,
  CASE WHEN starts_with(o_orderpriority, '1') THEN 'high' WHEN starts_with(o_orderpriority, '2') THEN 'mid'
       WHEN starts_with(o_orderpriority, '5') THEN 'low' WHEN starts_with(o_orderpriority, '4') THEN 'max'
  END AS effort,
  CASE WHEN o_orderstatus = 'O' THEN 'md' WHEN o_orderstatus = 'P' THEN 'json'
       WHEN o_orderkey % 97 = 0 THEN 'pdf' END AS output_format,
  CASE WHEN o_orderkey % 11 = 0 THEN 'out/s_' || o_orderkey || '.md'
       WHEN o_orderkey % 11 = 1 THEN 'out/s_' || o_orderkey END AS target,
  CAST(CASE WHEN o_orderkey % 6 = 0 THEN o_orderkey % 5 END AS INTEGER) AS desc_level,
  CAST(CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 4 END AS INTEGER) AS sum_level
FROM orders)"""


def _d_p2() -> str:
    eff = ", ".join(f"'{e}'" for e in R.EFFORTS)
    out = ", ".join(f"'{e}'" for e in R.OUTPUT_FORMATS)
    return (f"CASE WHEN effort IS NOT NULL AND effort NOT IN ({eff}) THEN "
            f"'invalid effort value: ''' || effort || ''' (choose from {', '.join(R.EFFORTS)})' "
            f"WHEN output_format IS NOT NULL AND output_format NOT IN ({out}) THEN "
            f"'invalid output_format value: ''' || output_format || ''' (choose from "
            f"{', '.join(R.OUTPUT_FORMATS)})' END")


def _d_p1(exists: str) -> str:
    need = R._needs_model
    lv_lo, lv_hi = R.LEVEL_MIN, R.LEVEL_MAX
    return f"""CASE WHEN NOT ({exists}) THEN 'File not found: ' || doc_id
  WHEN sentences IS NOT NULL AND NOT use_model THEN '{need("sentences")}'
  WHEN sentences IS NOT NULL AND (sentences < {R.SENTENCES_MIN} OR sentences > {R.SENTENCES_MAX})
    THEN 'Sentences cannot be less than {R.SENTENCES_MIN} and more than {R.SENTENCES_MAX}! Current amount: ' || sentences
  WHEN effort IS NOT NULL AND NOT use_model THEN '{need("effort")}'
  WHEN target IS NOT NULL AND NOT use_model THEN '{need("target")}'
  WHEN output_format IS NOT NULL AND output_format <> '{R.DEFAULT_OUTPUT}' AND NOT use_model
    THEN '{need("output_format")}'
  WHEN desc_level IS NOT NULL AND desc_level <> 0 AND NOT use_model THEN '{need("desc_level")}'
  WHEN desc_level IS NOT NULL AND (desc_level < {lv_lo} OR desc_level > {lv_hi})
    THEN 'Description level must be between {lv_lo} and {lv_hi}. Got: ' || desc_level
  WHEN sum_level IS NOT NULL AND sum_level <> 0 AND NOT use_model THEN '{need("sum_level")}'
  WHEN sum_level IS NOT NULL AND (sum_level < {lv_lo} OR sum_level > {lv_hi})
    THEN 'Summary level must be between {lv_lo} and {lv_hi}. Got: ' || sum_level
END"""


_D_VALIDATED = f"""(SELECT r.*, COALESCE(p2, p1) AS error,
       CASE WHEN p2 IS NOT NULL THEN 'invalid_value' WHEN p1 IS NOT NULL THEN 'rejected' END AS error_class
FROM (SELECT q.*, {_d_p2()} AS p2, {_d_p1('d.doc_id IS NOT NULL')} AS p1, d.text AS _text
      FROM {_D_REQ} q LEFT JOIN documents d USING (doc_id)) r)"""


def _d_map(col: str, table: dict, default) -> str:
    whens = " ".join(f"WHEN {_sq(str(k)) if isinstance(k, str) else k} THEN {_sq(v)}" for k, v in table.items())
    return f"COALESCE(CASE {col} {whens} END, {_sq(default)})"


_D_RESOLVED = f"""(SELECT req_id, doc_id, use_model, target, _text,
   {_d_map('effort', R.EFFORT_TO_MODEL, R.EFFORT_TO_MODEL[R.DEFAULT_EFFORT])} AS model,
   CAST(COALESCE(sentences, {R.DEFAULT_SENTENCES}) AS INTEGER) AS sentences,
   COALESCE(output_format, '{R.DEFAULT_OUTPUT}') AS output_format,
   CAST(COALESCE(desc_level, {R.DEFAULT_LEVEL}) AS INTEGER) AS desc_level,
   CAST(COALESCE(sum_level, {R.DEFAULT_LEVEL}) AS INTEGER) AS sum_level,
   {R.DEFAULT_MAX_RETRIES} AS max_retries,
   {_d_map('COALESCE(desc_level, 2)', R.DESCRIPTION_LEVELS, R.DESCRIPTION_LEVELS[R.DEFAULT_LEVEL])} AS desc_instruction,
   {_d_map('COALESCE(sum_level, 2)', R.SUMMARY_LEVELS, R.SUMMARY_LEVELS[R.DEFAULT_LEVEL])} AS sum_instruction
 FROM {_D_VALIDATED} v WHERE error_class IS NULL)"""

_D_STRIP_WS = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"


# the prompts in full, stated here on their own
_D_PROMPT = f"""concat_ws(chr(10), 'Task: summarise the document at the end of this brief',
  CASE output_format
    WHEN 'txt' THEN 'Form: txt - plain text, no Markdown and no JSON'
    WHEN 'md' THEN 'Form: md - Markdown'
    WHEN 'json' THEN 'Form: json - a single valid JSON object, neither fenced nor commented'
    ELSE 'Form: plain text, no Markdown and no JSON (taken because the requested form is unknown)' END,
  CASE output_format
    WHEN 'md' THEN 'Style: polished wording, an empty line between sections, headers and bullets where useful'
    WHEN 'json' THEN 'Style: snake_case keys, facts of the document only'
    ELSE 'Style: polished wording, an empty line between sections, short paragraphs or simple bullet lines' END,
  CASE output_format WHEN 'json' THEN
    'Shape: {{"document_title": "", "short_description": "", "short_summary": "", "full_summary": ""}}' END,
  'Length of ' || CASE output_format WHEN 'md' THEN 'summary section' WHEN 'json' THEN 'full_summary' ELSE 'summary' END
    || ': ' || sentences || ' sentences or fewer',
  CASE output_format WHEN 'json' THEN 'Length of short_description: exactly 3 sentences' END,
  CASE output_format WHEN 'json' THEN 'Length of short_summary: 2 or 3 sentences' END,
  CASE output_format WHEN 'json' THEN 'Value of document_title: the empty string where the document has no title' END,
  'Description: ' || desc_instruction, 'Summary: ' || sum_instruction || '.',
  'Document:' || chr(10) || trim(_text, {_D_STRIP_WS}))"""


def _req_pipeline(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    # the document side is the join's build/shuffle side: never pre-spread
    docs = table(spark, sf_dir, "documents", spread_by=())
    return R.requests_from_orders(orders), docs


@register("check_allowed_values", f"""
SELECT req_id, CASE WHEN p2 IS NOT NULL THEN 'invalid_value' END AS error_class, p2 AS error
FROM (SELECT req_id, {_d_p2()} AS p2 FROM {_D_REQ} q) t
""")
def q_check_allowed(spark, sf_dir):
    req, _ = _req_pipeline(spark, sf_dir)
    return R.check_allowed_values(req).select("req_id", "error_class", "error")


@register("validate_requests", f"""
SELECT req_id, doc_id, error_class, error FROM {_D_VALIDATED} v
""")
def q_validate(spark, sf_dir):
    req, docs = _req_pipeline(spark, sf_dir)
    return R.validate_requests(req, docs.select("doc_id")).select("req_id", "doc_id", "error_class", "error")


def _valid_resolved(spark, sf_dir):
    req, docs = _req_pipeline(spark, sf_dir)
    valid, _ = R.split_valid(R.validate_requests(req, docs.select("doc_id")))
    return R.resolve_levels(R.resolve_options(valid.drop("error_class", "error"))), docs


@register("resolve_model", f"SELECT req_id, model FROM {_D_RESOLVED} x")
def q_resolve_model(spark, sf_dir):
    res, _ = _valid_resolved(spark, sf_dir)
    return res.select("req_id", "model")


@register("resolve_options", f"""
SELECT req_id, model, sentences, output_format, desc_level, sum_level, max_retries FROM {_D_RESOLVED} x
""")
def q_resolve_options(spark, sf_dir):
    res, _ = _valid_resolved(spark, sf_dir)
    return res.select("req_id", "model", "sentences", "output_format", "desc_level", "sum_level",
                      "max_retries")


@register("resolve_levels", f"SELECT req_id, desc_instruction, sum_instruction FROM {_D_RESOLVED} x")
def q_resolve_levels(spark, sf_dir):
    res, _ = _valid_resolved(spark, sf_dir)
    return res.select("req_id", "desc_instruction", "sum_instruction")


def _model_calls(spark, sf_dir):
    # the same single-join preparation the summarize plan uses
    from docweave.plans.summarize import prepare_requests
    req, docs = _req_pipeline(spark, sf_dir)
    prep = prepare_requests(req, docs)
    calls = prep.where((F.col("route") == "model") & F.col("_t.error").isNull())
    return calls.withColumn("prompt", M.build_prompt("_text"))


_D_TARGET_ERR = ("(target IS NOT NULL AND regexp_extract(target, '^.+(\\.[^.]+)$', 1) <> '' "
                 "AND regexp_extract(target, '^.+(\\.[^.]+)$', 1) <> '.' || output_format)")
_D_CALLS = f"(SELECT x.*, {_D_PROMPT} AS prompt FROM {_D_RESOLVED} x WHERE use_model AND NOT {_D_TARGET_ERR})"


@register("build_prompt", f"SELECT req_id, prompt FROM {_D_CALLS} c")
def q_build_prompt(spark, sf_dir):
    return _model_calls(spark, sf_dir).select("req_id", "prompt")


def _d_reply() -> str:
    lead = _d_lead("_text", "sentences")
    body = f"CASE WHEN output_format = 'json' THEN '```json' || chr(10) || '{{\"full_summary\": ' || to_json({lead}) || '}}' || chr(10) || '```' ELSE {lead} END"
    return body


_D_INFER = f"""(SELECT req_id, doc_id, output_format, target, _text, sentences,
   CAST(CASE WHEN length(prompt) % 4 = 3 THEN 3 ELSE length(prompt) % 4 + 1 END AS INTEGER) AS attempts,
   CASE WHEN length(prompt) % 4 = 3 THEN '{M.API_ERROR}' ELSE '{M.OK}' END AS status,
   CASE WHEN length(prompt) % 4 = 3 THEN NULL ELSE {_d_reply()} END AS content,
   CASE WHEN length(prompt) % 4 = 3 THEN 'provider failed after 3 attempts: transient failure 3' END AS error
 FROM {_D_CALLS} c)"""


@register("infer_batch", f"SELECT req_id, content, attempts, status, error FROM {_D_INFER} i")
def q_infer_batch(spark, sf_dir):
    calls = _model_calls(spark, sf_dir)
    out = M.infer_batch(calls, M.LeadProvider(),
                        initial_delay=0.0)
    return out.select("req_id", "content", "attempts", "status", "error")


@register("degrade_errors", f"""
SELECT req_id, CASE WHEN status = 'ok' THEN content ELSE 'Model summarization failed: ' || error END AS summary
FROM {_D_INFER} i
""")
def q_degrade(spark, sf_dir):
    calls = _model_calls(spark, sf_dir)
    out = M.infer_batch(calls, M.LeadProvider(),
                        initial_delay=0.0)
    return out.select("req_id", M.degrade_errors().alias("summary"))


@register("check_reply", """
SELECT conv_id, turn, CASE WHEN trim(r, ' ' || chr(9) || chr(10) || chr(13)) = '' THEN 'bad_reply' ELSE 'ok' END
         AS status
FROM (SELECT conv_id, turn, regexp_replace(text, '[^\\s.!?]', '', 'g') AS r FROM conversations) t
""")
def q_check_reply(spark, sf_dir):
    # replies = each turn reduced to its punctuation and spacing (some blank)
    conv = table(spark, sf_dir, "conversations")
    return conv.select("conv_id", "turn", M.check_reply(
        F.regexp_replace("text", r"[^\s.!?]", "")).alias("status"))


@register("resolve_target", f"""
SELECT req_id,
  CASE WHEN target IS NULL THEN NULL
       WHEN regexp_extract(target, '^.+(\\.[^.]+)$', 1) = '' THEN target || '.' || fmt
       WHEN regexp_extract(target, '^.+(\\.[^.]+)$', 1) = '.' || fmt THEN target END AS target_path,
  CASE WHEN target IS NOT NULL AND regexp_extract(target, '^.+(\\.[^.]+)$', 1) NOT IN ('', '.' || fmt)
       THEN 'Output file extension ''' || regexp_extract(target, '^.+(\\.[^.]+)$', 1)
            || ''' does not match requested format ''' || fmt || '''' END AS error
FROM (SELECT req_id, target, COALESCE(output_format, 'txt') AS fmt FROM {_D_REQ} q) t
""")
def q_resolve_target(spark, sf_dir):
    from docweave.operators.output import resolve_target
    req, _ = _req_pipeline(spark, sf_dir)
    t = resolve_target("target", F.coalesce("output_format", F.lit("txt")))
    return req.select("req_id", t["path"].alias("target_path"), t["error"].alias("error"))


# O1: replies shaped from documents: fenced JSON, bare JSON, broken JSON, text
def _replies_spark(docs):
    k = F.col("doc_id") % 4
    content = (F.when(k == 0, F.concat(F.lit('```json\n{"doc": '), F.col("doc_id").cast("string"),
                                       F.lit(', "lang": "'), F.col("lang"), F.lit('"}\n```')))
                .when(k == 1, F.concat(F.lit('  {"n_chars": '), F.col("n_chars").cast("string"), F.lit("} ")))
                .when(k == 2, F.concat(F.lit("```json\n{broken "), F.col("source"), F.lit("\n```")))
                .otherwise(F.col("text")))
    fmt = F.when(k == 3, F.lit("txt")).otherwise(F.lit("json"))
    return docs.select("doc_id", content.alias("content"), fmt.alias("output_format"))


@register("normalize_output", f"""
SELECT doc_id,
  CASE doc_id % 4
    WHEN 0 THEN '{{' || chr(10) || '  "doc": ' || doc_id || ',' || chr(10) || '  "lang": ' || to_json(lang)
                || chr(10) || '}}' || chr(10)
    WHEN 1 THEN '{{' || chr(10) || '  "n_chars": ' || n_chars || chr(10) || '}}' || chr(10)
    WHEN 2 THEN '{{broken ' || source
    ELSE trim(text, {_D_STRIP_WS}) END AS saved_content
FROM documents
""")
def q_normalize_output(spark, sf_dir):
    from docweave.operators.output import normalize_output
    rep = _replies_spark(table(spark, sf_dir, "documents"))
    return rep.select("doc_id", normalize_output("content", "output_format").alias("saved_content"))


# ---------------------------------------------------------------------------
# G1: the supplied tables seen as a folder of files, one file per row
def _corpus_spark(spark, sf_dir):
    # the union is spread once as a whole (below), not source by source
    def rows(name, path, content):
        return table(spark, sf_dir, name, spread_by=()).select(path.alias("path"), content.alias("content"))

    c = F.col
    o = table(spark, sf_dir, "orders", spread_by=())
    parts = [
        rows("documents", F.concat(F.lit("documents/"), c("doc_id").cast("string"), F.lit(".txt")), c("text")),
        rows("pages", F.concat(F.lit("pages/"), c("page_id").cast("string"), F.lit(".html")), c("html")),
        rows("events", F.concat(F.lit("events/"), c("event_id").cast("string"), F.lit(".json")), c("props")),
        rows("conversations", F.concat(F.lit("conversations/"), c("conv_id").cast("string"), F.lit("-"),
                                       c("turn").cast("string"), F.lit(".docx")), c("text")),
        rows("labels", F.concat(F.lit("labels/"), c("doc_id").cast("string"), F.lit(".parquet")),
             c("quality").cast("string")),
        o.select(F.concat(F.lit("orders/"), c("o_orderkey").cast("string"), F.lit(".xml")).alias("path"),
                 _xml_doc_spark(o).alias("content")),
        rows("benchmark", F.concat(F.lit("benchmark/"), c("item_id").cast("string"), F.lit(".csv")),
             c("text")),
        rows("conversations", F.concat(F.lit("notebooks/"), c("conv_id").cast("string"), F.lit("-"),
                                       c("turn").cast("string"), F.lit(".ipynb")), _nb_json_spark(c("text"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    # one file per row: a union of a few single-file scans is spread by path
    # (a large corpus has far more splits and is left as it is)
    from docweave.session import spread
    return spread(out, ["path"], min_partitions=2 * spark.sparkContext.defaultParallelism)


_D_HTML_TEXT = (f"array_to_string(list_filter(list_transform(string_split({_d_unescape(_D_MARKED)}, chr(1)), "
                f"lambda n: trim(n, {_D_WS})), lambda n: n <> ''), chr(10))")
_D_UNSUPPORTED = f"'Unsupported file type: .parquet. Supported: {FMT.supported_list()}'"
_D_CSV_PREVIEW = """array_to_string(list_transform(
      list_slice(CASE WHEN suffix(text, chr(10)) THEN list_slice(string_split(text, chr(10)), 1, -2)
                      ELSE string_split(text, chr(10)) END, 1, 20),
      lambda l: array_to_string(list_filter(string_split(l, ','), lambda c: c <> ''), ', ')), chr(10))"""
_D_NOTEBOOK = r"""COALESCE(array_to_string(flatten(list_transform(
      list_filter(list_transform(string_split(text, chr(10)),
                                 lambda l, i: {'t': CASE WHEN (i - 1) % 3 = 0 THEN 'code' ELSE 'markdown' END,
                                               's': CASE WHEN (i - 1) % 2 = 0 THEN l || chr(10) ELSE l END}),
                  lambda c: trim(c.s, ' ' || chr(9) || chr(10) || chr(13)) <> ''),
      lambda c: CASE WHEN c.t = 'code' THEN ['# code cell', c.s] ELSE [c.s] END)),
    chr(10) || chr(10)), '')"""


@register("loader_report", f"""
WITH t AS (
  SELECT '.txt' AS ext, 'documents/' || doc_id || '.txt' AS path, text, NULL AS error_class, NULL AS error
  FROM documents
  UNION ALL SELECT '.html', 'pages/' || page_id || '.html', {_D_HTML_TEXT}, NULL, NULL FROM pages
  UNION ALL SELECT '.json', 'events/' || event_id || '.json',
     '{{' || chr(10) || '  "k": ' || CAST(CAST(json_extract(props, '$.k') AS BIGINT) AS VARCHAR) || chr(10) || '}}',
     NULL, NULL FROM events
  UNION ALL SELECT '.docx', 'conversations/' || conv_id || '-' || turn || '.docx', NULL, 'missing_dependency',
     {_sq(FMT.MISSING_DEPENDENCY_HINT['docx'])} FROM conversations
  UNION ALL SELECT '.parquet', 'labels/' || doc_id || '.parquet', NULL, 'unsupported_type', {_D_UNSUPPORTED}
  FROM labels
  UNION ALL SELECT '.xml', 'orders/' || o_orderkey || '.xml', {_D_XML_OUTLINE}, NULL, NULL FROM orders
  UNION ALL SELECT '.csv', 'benchmark/' || item_id || '.csv', {_D_CSV_PREVIEW}, NULL, NULL FROM benchmark
  UNION ALL SELECT '.ipynb', 'notebooks/' || conv_id || '-' || turn || '.ipynb', {_D_NOTEBOOK}, NULL, NULL
  FROM conversations
)
SELECT ext, count(*) AS n_files, count(*) FILTER (WHERE error_class IS NULL) AS n_ok,
       CAST(COALESCE(sum(length(text)) FILTER (WHERE error_class IS NULL), 0) AS BIGINT) AS n_chars,
       arg_min(substring(text, 1, 200), CASE WHEN error_class IS NULL THEN path END) AS preview,
       arg_min(error_class, CASE WHEN error_class IS NOT NULL THEN path END) AS error_class,
       arg_min(error, CASE WHEN error_class IS NOT NULL THEN path END) AS error,
       bool_and(count(*) = count(*) FILTER (WHERE error_class IS NULL)) OVER () AS all_ok
FROM t GROUP BY ext
""")
def q_loader_report(spark, sf_dir):
    from docweave.operators.report import loader_report
    from docweave.sources.files import load_corpus_text
    texts = load_corpus_text(_corpus_spark(spark, sf_dir))
    return loader_report(texts)


# M5: every request routed, summarised and degraded where it failed
def _d_summarize() -> str:
    need = f"""(SELECT x.*, {_D_TARGET_ERR} AS bad_target,
       CASE WHEN {_D_TARGET_ERR} THEN 'Output file extension ''' || regexp_extract(target, '^.+(\\.[^.]+)$', 1)
            || ''' does not match requested format ''' || output_format || '''' END AS target_error,
       CASE WHEN target IS NULL THEN NULL
            WHEN regexp_extract(target, '^.+(\\.[^.]+)$', 1) = '' THEN target || '.' || output_format
            ELSE target END AS target_path
     FROM {_D_RESOLVED} x)"""
    local = (f"array_to_string(list_transform({_d_chunks('_text')}, lambda c: {_d_lead('c', 2)}), "
             f"chr(10) || chr(10))")
    lead = _d_lead("_text", "sentences")
    norm_json = (f"'{{' || chr(10) || '  \"full_summary\": ' || to_json({lead}) || chr(10) || '}}' || chr(10)")
    return f"""
SELECT req_id, doc_id, 'rejected' AS route, output_format, NULL AS content, NULL AS saved_content,
       NULL AS target_path, 0 AS attempts, 'rejected' AS status, error_class, error
FROM {_D_VALIDATED} v WHERE error_class IS NOT NULL
UNION ALL
SELECT req_id, doc_id, 'local', output_format, {local}, NULL, NULL, 0, 'ok', NULL, NULL
FROM {_D_RESOLVED} x WHERE NOT use_model
UNION ALL
SELECT req_id, doc_id, 'model', output_format, 'Model configuration error: ' || target_error, NULL, NULL, 0,
       'config_error', 'config_error', target_error
FROM {need} n WHERE use_model AND bad_target
UNION ALL
SELECT req_id, doc_id, 'model', output_format,
       CASE WHEN status = 'ok' THEN content ELSE 'Model summarization failed: ' || error END,
       CASE WHEN status = 'ok' AND target_path IS NOT NULL THEN
            CASE WHEN output_format = 'json' THEN {norm_json} ELSE content END END,
       target_path, attempts, status, CASE WHEN status <> 'ok' THEN status END, error
FROM (SELECT i.*, CASE WHEN target IS NULL THEN NULL
            WHEN regexp_extract(target, '^.+(\\.[^.]+)$', 1) = '' THEN target || '.' || output_format
            ELSE target END AS target_path FROM {_D_INFER} i) m
"""


@register("summarize", _d_summarize())
def q_summarize(spark, sf_dir):
    from docweave.plans.summarize import summarize
    req, docs = _req_pipeline(spark, sf_dir)
    return summarize(req, docs, M.LeadProvider(),
                     initial_delay=0.0)


# ---------------------------------------------------------------------------
# Documents as rows, for those that fit no row; the reply contract as columns

# a language's documents as the parts of one text
@register("part_rows", """
SELECT lang, doc_id, text, CAST(coalesce(sum(length(text) + 2) OVER (
         PARTITION BY lang ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
FROM documents WHERE regexp_matches(text, '[^ \\t\\n\\r\\f\\x0b]')
""")
def q_part_rows(spark, sf_dir):
    """Written in order by many tasks, and read back."""
    from docweave.operators.assemble import part_rows, write_part_rows
    from docweave.sources.scratch import scratch_dir
    out = scratch_dir(spark, "parts")
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", "text")
    write_part_rows(part_rows(docs, ("lang",), "doc_id", block_parts=64), out, ("lang",))
    return spark.read.parquet(out)


# one notebook per conversation turn, as in notebook_text; its cells as rows
@register("notebook_cells", r"""
SELECT conv_id, turn, CAST(i - 1 AS INTEGER) AS cell_no, CASE WHEN (i - 1) % 3 = 0 THEN 'code' ELSE 'markdown' END AS cell_type,
       CASE WHEN (i - 1) % 2 = 0 THEN l || chr(10) ELSE l END AS text
FROM (SELECT conv_id, turn, unnest(ls) AS l, unnest(range(1, len(ls) + 1)) AS i
      FROM (SELECT conv_id, turn, string_split(text, chr(10)) AS ls FROM conversations))
WHERE trim(l, ' ' || chr(9) || chr(10) || chr(13)) <> ''
""")
def q_notebook_cells(spark, sf_dir):
    from docweave.operators.structured import notebook_cells
    conv = table(spark, sf_dir, "conversations")
    return notebook_cells(conv.select("conv_id", "turn", _nb_json_spark(F.col("text")).alias("nb")), "nb", ("conv_id", "turn"))


# each language's documents as one text, in files that many tasks write, cut into small blocks
@register("big_text_summaries", f"""
SELECT lang, CAST(length(t) AS BIGINT) AS n_chars,
       array_to_string(list_transform({_d_chunks('t')}, lambda c: {_d_lead('c', 2)}), chr(10) || chr(10)) AS summary
FROM (SELECT lang, string_agg(replace(replace(coalesce(text, ''), chr(13) || chr(10), chr(10)), chr(13), chr(10)) || chr(10), '' ORDER BY doc_id) AS t
      FROM documents GROUP BY lang)
""")
def q_big_text_summaries(spark, sf_dir):
    from docweave.sources.bigtext import big_text_summaries
    from docweave.sources.files import read_corpus
    from docweave.sources.scratch import scratch_dir
    out = scratch_dir(spark, "bigtext")
    # in order by many tasks: a language's text is the files of its folder, one after the other
    (table(spark, sf_dir, "documents").select("lang", "doc_id", "text").repartitionByRange("lang", "doc_id").sortWithinPartitions("lang", "doc_id")
     .select("lang", F.coalesce("text", F.lit("")).alias("text")).write.partitionBy("lang").text(out))
    files = read_corpus(spark, out, glob="*.txt", with_content=False).select(
        "path", "length", F.regexp_extract("path", _LANG_OF_PATH, 1).alias("text"), F.regexp_extract("path", "([^/]+)$", 1).alias("part"))
    return big_text_summaries(files, block_bytes=1 << 16).select(F.col("path").alias("lang"), "n_chars", "summary")


# replies made of the documents: fenced and bare, whole, lacking a key, broken
_REPLY_TEXT = "substring(COALESCE(text, ''), 1, 200)"


@register("json_reply", f"""
SELECT doc_id, CASE WHEN kind <> 4 THEN lang END AS document_title, CASE WHEN kind <> 4 THEN t END AS short_description,
       CASE WHEN kind IN (0, 1, 3) THEN source WHEN kind = 2 THEN CAST(doc_id AS VARCHAR) END AS short_summary,
       CASE WHEN kind IN (0, 1, 2) THEN t END AS full_summary,
       CASE WHEN kind <= 2 THEN 'ok' ELSE 'bad_reply' END AS status,
       CASE kind WHEN 3 THEN 'the reply lacks full_summary' WHEN 4 THEN 'the reply is not a JSON object' END AS error
FROM (SELECT doc_id, lang, source, doc_id % 5 AS kind, {_REPLY_TEXT} AS t FROM documents)
""")
def q_json_reply(spark, sf_dir):
    from docweave.operators.output import json_reply
    t, kind = F.substring(F.coalesce("text", F.lit("")), 1, 200), F.col("doc_id") % 5
    whole = [F.col("lang").alias("document_title"), t.alias("short_description"), F.col("source").alias("short_summary")]
    number = F.struct(*whole[:2], F.col("doc_id").alias("short_summary"), t.alias("full_summary"))
    content = (F.when(kind == 0, F.to_json(F.struct(*whole, t.alias("full_summary"))))
                .when(kind == 1, F.concat(F.lit("```json\n"), F.to_json(F.struct(*whole, t.alias("full_summary"))), F.lit("\n```\n")))
                .when(kind == 2, F.to_json(number)).when(kind == 3, F.to_json(F.struct(*whole)))
                .otherwise(F.concat(F.lit('{"document_title": '), F.col("lang"))))
    return table(spark, sf_dir, "documents").select("doc_id", json_reply(content).alias("r")).select("doc_id", "r.*")


# ---------------------------------------------------------------------------
# S1, S3, U1, S7 (files), O3: files written by Spark from the supplied tables
# into the shared checkpoint folder, then read back as a corpus.
FILE_DOCS = 64  # documents per written file


def _write_document_files(spark, sf_dir) -> str:
    from docweave.sources.scratch import scratch_dir
    out = scratch_dir(spark, "corpus")
    (table(spark, sf_dir, "documents").select("lang", "text")
     .write.mode("overwrite").option("maxRecordsPerFile", FILE_DOCS)
     .partitionBy("lang").text(out))
    return out


_LANG_OF_PATH = r"lang=([^/]+)/"


@register("read_corpus", """
SELECT lang, CAST(sum(strlen(COALESCE(text, '')) + 1) AS BIGINT) AS length, CAST(NULL AS VARCHAR) AS error_class
FROM documents GROUP BY lang
UNION ALL SELECT 'xx', 0, 'not_found'
""")
def q_read_corpus(spark, sf_dir):
    """Bytes per language: however the writer cuts files, a document is its text and a line end."""
    from docweave.sources.files import read_corpus
    root = _write_document_files(spark, sf_dir)
    files = read_corpus(spark, root, glob="*.txt", wanted=[root + "/lang=xx/missing.txt"])
    return files.groupBy(F.regexp_extract("path", _LANG_OF_PATH, 1).alias("lang"), "error_class").agg(
        F.coalesce(F.sum("length"), F.lit(0)).alias("length"))


@register("decode_text", """
SELECT lang, line, count(*) AS n FROM (
  SELECT lang, unnest(string_split(left(t, length(t) - 1), chr(10))) AS line FROM (
    SELECT lang, replace(replace(COALESCE(text, '') || chr(10), chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t
    FROM documents))
GROUP BY lang, line
""")
def q_decode_text(spark, sf_dir):
    """How often each line of the decoded files stands in a language."""
    from docweave.sources.files import decode_text, read_corpus
    files = read_corpus(spark, _write_document_files(spark, sf_dir), glob="*.txt")
    text = decode_text("content")
    lines = files.select(F.regexp_extract("path", _LANG_OF_PATH, 1).alias("lang"),
                         F.explode(F.split(F.left(text, F.char_length(text) - 1), "\n")).alias("line"))
    return lines.groupBy("lang", "line").agg(F.count(F.lit(1)).alias("n"))


def _word_join(b: bytes) -> str:
    """A user extractor: whitespace-separated words, one space apart."""
    return " ".join(b.decode("utf-8", "replace").split())


@register("custom_extractor", f"""
SELECT lang, '.txt' AS ext, 'custom' AS kind, CAST(sum(length(t) + 1) AS BIGINT) AS n_chars,
       CAST(NULL AS VARCHAR) AS error_class
FROM (SELECT lang, {_d_norm("COALESCE(text, '')")} AS t FROM documents) WHERE t <> '' GROUP BY lang
""")
def q_custom_extractor(spark, sf_dir):
    """Characters of all words per language, each with one that ends it."""
    from docweave.sources.files import load_corpus_text, read_corpus
    files = read_corpus(spark, _write_document_files(spark, sf_dir), glob="*.txt")
    texts = load_corpus_text(files, extractors={".txt": _word_join})
    return texts.where("text <> '' OR error_class IS NOT NULL").groupBy(
        F.regexp_extract("path", _LANG_OF_PATH, 1).alias("lang"), "ext", "kind", "error_class").agg(
        F.sum(F.char_length("text") + 1).alias("n_chars"))


@register("read_corpus_files", """
SELECT CAST(doc_id AS VARCHAR) AS doc, CAST(CASE WHEN doc_id % 50 = 0 THEN 0 ELSE strlen(COALESCE(text, '')) END AS BIGINT) AS length,
       CAST(NULL AS VARCHAR) AS error_class FROM documents
UNION ALL SELECT 'missing', 0, 'not_found'
""")
def q_read_corpus_files(spark, sf_dir):
    """A file per document, every 50th one empty: all of them are rows."""
    from docweave.sources.files import read_corpus
    root = _write_one_file_each(spark, sf_dir)
    files = read_corpus(spark, root, glob="*.txt", wanted=[root + "/missing.txt"], with_content=False)
    return files.select(F.regexp_extract("path", r"([^/]+)\.txt$", 1).alias("doc"), F.coalesce("length", F.lit(0)).alias("length"), "error_class")


FILE_FOLDERS = 64  # folders that files of a row each are dealt over, to be listed apart


def _folder_of(key) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(FILE_FOLDERS)).cast("string")


def _write_one_file_each(spark, sf_dir) -> str:
    """documents as one text file each, every 50th one of no length."""
    from docweave.operators.output import export_files
    from docweave.sources.scratch import scratch_dir
    root = scratch_dir(spark, "files")
    text = F.when(F.col("doc_id") % 50 == 0, F.lit("")).otherwise(F.coalesce("text", F.lit("")))
    export_files(table(spark, sf_dir, "documents").select(
        F.concat(F.lit(f"{root}/"), _folder_of("doc_id"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("target_path"),
        text.alias("saved_content")))
    return root


@register("csv_file_preview", """
SELECT o_orderpriority AS priority, string_agg(line, chr(10) ORDER BY o_orderkey) AS preview, CAST(NULL AS VARCHAR) AS error FROM (
  SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r,
         o_orderkey || ', said "now,"' || chr(10) || 'on two lines' || CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE ', ' || o_orderstatus END AS line
  FROM orders) WHERE r <= 20 GROUP BY o_orderpriority
""")
def q_csv_file_preview(spark, sf_dir):
    """A file per priority, with quotes, line breaks and empty cells in its records."""
    from docweave.operators.structured import csv_file_preview
    from docweave.sources.scratch import scratch_dir
    out = scratch_dir(spark, "csv")
    key = F.col("o_orderkey")
    (table(spark, sf_dir, "orders").select(
        "o_orderpriority", key, F.lit('said "now,"\non two lines').alias("note"),
        F.when(key % 3 != 0, F.col("o_orderstatus")).alias("status"))
     .repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "o_orderkey")
     .write.partitionBy("o_orderpriority").option("escape", '"').csv(out))
    return csv_file_preview(spark, out, glob="*.csv").select(
        F.regexp_extract("path", "o_orderpriority=([^/]+)/", 1).alias("priority"), "preview", "error")


@register("export_files", f"SELECT target_path, saved_content FROM ({_d_summarize()}) s WHERE saved_content IS NOT NULL")
def q_export_files(spark, sf_dir):
    """Every summary with a target in a file of its own, read back."""
    from docweave.operators.output import export_files
    from docweave.plans.summarize import summarize
    from docweave.sources.files import decode_text, read_corpus
    from docweave.sources.scratch import scratch_dir
    req, docs = _req_pipeline(spark, sf_dir)
    root = scratch_dir(spark, "exported")
    out = summarize(req, docs, M.LeadProvider(), initial_delay=0.0)
    export_files(out.withColumn("target_path", F.concat(F.lit(f"{root}/"), "target_path")))
    return read_corpus(spark, root).select(
        F.substring_index("path", "/", -2).alias("target_path"), decode_text("content", fold_newlines=False).alias("saved_content"))


@register("write_summaries", _d_summarize())
def q_write_summaries(spark, sf_dir):
    from docweave.operators.output import write_summaries
    from docweave.plans.summarize import OUT_COLS, summarize
    from docweave.sources.scratch import scratch_dir
    req, docs = _req_pipeline(spark, sf_dir)
    out = scratch_dir(spark, "summaries")
    write_summaries(summarize(req, docs, M.LeadProvider(),
                              initial_delay=0.0), out)
    back = spark.read.parquet(out)
    return back.select(*[F.col(c).cast("string").alias(c) if c == "output_format" else F.col(c)
                         for c in OUT_COLS])


# ---------------------------------------------------------------------------
# Streaming: documents written as files, summarised by an availableNow stream
@register("stream_summaries", f"""
SELECT CAST(doc_id AS VARCHAR) AS title, '.txt' AS ext, 'text' AS kind, CAST(length(t) AS BIGINT) AS n_chars,
       array_to_string(list_transform({_d_chunks('t')}, lambda c: {_d_lead('c', 2)}), chr(10) || chr(10)) AS summary,
       CAST(NULL AS VARCHAR) AS error_class
FROM (SELECT doc_id, replace(replace(CASE WHEN doc_id % 50 = 0 THEN '' ELSE COALESCE(text, '') END,
                                     chr(13) || chr(10), chr(10)), chr(13), chr(10)) AS t FROM documents)
""")
def q_stream_summaries(spark, sf_dir):
    from docweave.sources.scratch import scratch_dir
    from docweave.streaming.incremental import run_incremental
    src = _write_one_file_each(spark, sf_dir)
    sink = scratch_dir(spark, "stream-sink")
    run_incremental(spark, src, sink, scratch_dir(spark, "stream-ckpt"), glob="*.txt")
    return spark.read.parquet(sink).select("title", "ext", "kind", F.col("n_chars").cast("long").alias("n_chars"), "summary", "error_class")


@register("stream_loader_report", """
SELECT ext, count(*) AS n_files, count(*) FILTER (WHERE error_class IS NULL) AS n_ok, max(error_class) AS error_class,
       bool_and(bool_and(error_class IS NULL)) OVER () AS all_ok
FROM (SELECT '.txt' AS ext, CAST(NULL AS VARCHAR) AS error_class FROM documents
      UNION ALL SELECT '.html', NULL FROM pages
      UNION ALL SELECT '.json', CASE WHEN c_custkey % 10 = 0 THEN 'bad_json' END FROM customer
      UNION ALL SELECT '.part', 'unsupported_type' FROM supplier) GROUP BY ext
""")
def q_stream_loader_report(spark, sf_dir):
    """Documents, pages, customers and suppliers as files of four kinds; a tenth
    of the customers is no JSON."""
    from docweave.operators.output import export_files
    from docweave.sources.scratch import scratch_dir
    from docweave.streaming.incremental import run_incremental_report
    root = _write_one_file_each(spark, sf_dir)

    def write(name, key, ext, text):
        rows = table(spark, sf_dir, name)
        target = F.concat(F.lit(f"{root}/{name}-"), _folder_of(key), F.lit("/"), F.col(key).cast("string"), F.lit(ext))
        export_files(rows.select(target.alias("target_path"), text.alias("saved_content")))

    write("pages", "page_id", ".html", F.coalesce("html", F.lit("")))
    write("customer", "c_custkey", ".json", F.when(F.col("c_custkey") % 10 == 0, F.lit('{"broken": ')).otherwise(F.to_json(F.struct("c_custkey"))))
    write("supplier", "s_suppkey", ".part", F.lit("not a known kind"))
    report = scratch_dir(spark, "stream-report")
    run_incremental_report(spark, root, report, scratch_dir(spark, "stream-report-ckpt"))
    return spark.read.parquet(report).select("ext", "n_files", "n_ok", "error_class", "all_ok")
