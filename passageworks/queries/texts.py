"""Text, markup, path and label queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from passageworks.functions import text as tx
from passageworks.operators import strategies as st
from passageworks.queries import inputs as inp
from passageworks.queries.registry import query
from passageworks.sources.files import allowed, text_by_type, with_text
from passageworks.sources.spread import spread


@query(
    "filter_extension",
    f"""WITH {inp.DOC_FILES}
SELECT filepath, document_name FROM doc_files
WHERE regexp_matches(filepath, '\\.(docx|txt|md)$') AND document_name NOT IN ('0.txt', '3.md')""",
)
def filter_extension(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.doc_files(spark, sf_dir).filter(
        allowed(F.col("filepath"), deny=["0.txt", "3.md"])
    ).select("filepath", "document_name")


@query(
    "filter_nonempty_docs",
    """WITH lines AS (
  SELECT doc_id, text AS document_text FROM documents UNION ALL
  SELECT doc_id, unnest(string_split(text, chr(10))[2:]) FROM documents UNION ALL
  SELECT doc_id, '' FROM documents WHERE doc_id % 3 = 0)
SELECT doc_id, document_text FROM lines WHERE document_text <> ''""",
)
def filter_nonempty_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole texts, all their later lines as documents of their own, and empty documents."""
    docs = inp.read(spark, sf_dir, "documents")
    lines = F.explode(F.slice(F.split("text", "\n", -1), F.lit(2), F.lit(1 << 30)))
    both = docs.select("doc_id", F.col("text").alias("document_text")).union(docs.select("doc_id", lines))
    empty = docs.where("doc_id % 3 = 0").select("doc_id", F.lit(""))
    return with_text(both.union(empty))


_BLANKS = "\t\n\u000b\u001c\u001f\u0085  　​"
_BLANKS_SQL = " || ".join(f"chr({ord(c)})" for c in _BLANKS)


@query(
    "filter_whitespace_chunks",
    f"""WITH words AS (
  SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1)::BIGINT - 1 AS pos
  FROM (SELECT doc_id, string_split(text, ' ') AS ws FROM documents)),
chunks AS (SELECT doc_id, pos, translate(w, 'ethnaoirsd', {_BLANKS_SQL}) AS c FROM words)
SELECT doc_id, pos, sha256(c) AS chunk_id FROM chunks
WHERE NOT regexp_full_match(c, '[\\s\\x0b\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+')""",
)
def filter_whitespace_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words with ten letters made blanks, one of them not white space at all."""
    chunk = F.translate("w", "ethnaoirsd", _BLANKS)
    return (
        inp.read_documents(spark, sf_dir)
        .select("doc_id", F.posexplode_outer(F.split("text", " ", -1)).alias("pos", "w"))
        .select("doc_id", F.col("pos").cast("long").alias("pos"), chunk.alias("c"))
        .filter(~tx.is_blank(F.col("c")))
        .select("doc_id", "pos", tx.sha256_hex(F.col("c")).alias("chunk_id"))
    )


# ---------------------------------------------------------------- markup


@query(
    "html_to_text",
    """WITH bare AS (
  SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html,
    '<(?:script\\b[^>]*>.*?</script|style\\b[^>]*>.*?</style)\\s*>', '', 'gis'),
    '<!--.*?-->', '', 'gs'), '</?[a-zA-Z!?][^>]*>', '', 'gs') AS t FROM pages)
SELECT page_id, replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', '·'),
  '&copy;', '©'), '&amp;', '&') AS text FROM bare""",
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(inp.read(spark, sf_dir, "pages"), "page_id").select(
        "page_id", tx.html_to_text(F.col("html")).alias("text")
    )


def _escaped(text: Column) -> Column:
    """A text in which a backslash stands before every mark, so that Markdown gives it back."""
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


# Of such a text only spaces at the ends of lines and blank lines are lost.
_BODY_SQL = r"""regexp_replace(regexp_replace({}, '[ \t]*\n[ \t\n]*', chr(10), 'g'), '^[ \t]+|[ \t]+$', '', 'g')"""


@query(
    "markdown_to_text",
    f"""SELECT doc_id, concat_ws(chr(10), source, lang || ' and ' || source || ' with c * d and em',
  'first ' || lang, 'of the first', 'second', 'said ' || source, 'Table:', 'lang | n,n', lang || ',' || n_chars,
  'broken', 'line', 'SELECT **', '') || {_BODY_SQL.format('text')} AS text,
  regexp_replace(text || chr(10), '^\\n+', '') AS fenced
FROM documents""",
)
def markdown_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each whole document as the body of a Markdown text with every kind of mark before it, its
    own marks escaped; and once more as it stands, in a fence."""
    source = F.col("source")
    marked = F.concat_ws(
        "\n",
        F.concat(F.lit("## "), source),
        F.lit(""),
        F.concat(
            F.lit("**"), F.col("lang"), F.lit("** and ["), source,
            F.lit("](http://a.example/b_c) with `c * d` and *em*![x](y.png)"),
        ),
        F.lit(""),
        F.concat(F.lit("- first "), F.col("lang")),
        F.lit(""),
        F.lit("  of the *first*"),
        F.lit("2. second"),
        F.concat(F.lit("> said "), source),
        F.lit(""),
        F.lit(r"| lang \| n | n |"),
        F.lit("|:---|---:|"),
        F.concat(F.lit("| "), F.col("lang"), F.lit(" | "), F.col("n_chars").cast("string"), F.lit(" |")),
        F.lit(""),
        F.lit("broken\\"),
        F.lit("  line"),
        F.lit("```sql"),
        F.lit("SELECT **"),
        F.lit("```"),
        _escaped(F.col("text")),
    )
    fenced = F.concat(F.lit("~~~~~~~~\n"), F.col("text"), F.lit("\n~~~~~~~~"))
    return inp.read_documents(spark, sf_dir).select(
        "doc_id", tx.markdown_to_text(marked).alias("text"), tx.markdown_to_text(fenced).alias("fenced")
    )


@query(
    "linearize_tables",
    """SELECT p_partkey, '<p>Table:' || chr(10) || 'key;value' || chr(10) || 'name;' || p_name
  || chr(10) || 'brand;<b>' || p_brand || '</b>' || chr(10) || chr(10) || 'size;' || p_size
  || chr(10) || '</p>' AS from_html,
  'Table:' || chr(10) || 'name,' || p_name || ' ' || p_type || chr(10) || 'size,' || p_size
  || chr(10) AS from_cells
FROM part""",
)
def linearize_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as an HTML table and as the cells of a word-processor table."""
    size = F.col("p_size").cast("string")
    html = F.concat(
        F.lit('<table class="t"><thead><tr><th>key</th><th align="left">value</th></tr></thead>'),
        F.lit("<tbody><tr><td>name</td><td>"), F.col("p_name"),
        F.lit("</td></tr>\n<tr><td>brand</td><td><b>"), F.col("p_brand"),
        F.lit("</b></td></tr><tr></tr><TR><TD>size</TD><TD>"), size,
        F.lit("</TD></TR></tbody></table>"),
    )
    cells = F.array(
        F.array(F.lit("name"), F.concat_ws("\n", "p_name", "p_type")),
        F.array(F.lit("size"), size),
    )
    return inp.read(spark, sf_dir, "part").select(
        "p_partkey",
        tx.linearize_html_table(html, separator=";").alias("from_html"),
        tx.linearize_cells(cells, F.lit(2)).alias("from_cells"),
    )


@query(
    "linearize_nested_tables",
    """SELECT p_partkey, '<p>Table:' || chr(10) || 'name,of  ' || p_name || ' ' || p_brand || '  all'
  || chr(10) || 'size,' || p_size || chr(10) || '</p>' AS text FROM part""",
)
def linearize_nested_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part as a table with a table in a cell."""
    html = F.concat(
        F.lit("<table><tr><td>name</td><td>of <table><tr><th>"), "p_name", F.lit("</th></tr><tr><td>"),
        "p_brand", F.lit("</td></tr></TABLE> all</td></tr><tr><td>size</td><td>"), F.col("p_size").cast("string"),
        F.lit("</td></tr></table>"),
    )
    return inp.read(spark, sf_dir, "part").select("p_partkey", tx.replace_html_tables(html).alias("text"))


@query(
    "extract_text_dispatch",
    f"""WITH {inp.DOC_FILES},
extracted AS (SELECT filepath, CASE WHEN filepath LIKE '%.docx' THEN 'package of ' || document_text
  WHEN filepath LIKE '%.txt' THEN '## ' || document_text
  WHEN filepath LIKE '%.md' THEN {_BODY_SQL.format('document_text')} ELSE '' END AS t FROM doc_files)
SELECT filepath, replace(replace(replace(t, chr(39), chr(39) || chr(39)), '\\', '\\\\'), '\\u', '\\\\u')
  AS document_text FROM extracted""",
)
def extract_text_dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of four types, whole texts: only the Markdown reader takes the heading mark away and
    reads escaped marks, and packages have a reader of their own."""
    path, text = F.col("filepath"), F.col("document_text")
    raw = F.concat(F.lit("## "), F.when(path.endswith(".md"), _escaped(text)).otherwise(text))
    read = text_by_type(path, raw, F.concat(F.lit("package of "), text), escape=True)
    return inp.doc_files(spark, sf_dir).select("filepath", read.alias("document_text"))


# ---------------------------------------------------------------- scalars


@query(
    "escape_sql_text",
    """WITH t AS (SELECT doc_id, translate(text, 'eo', chr(39) || '\\') AS t FROM documents)
SELECT doc_id, replace(replace(replace(t, chr(39), chr(39) || chr(39)), '\\', '\\\\'),
  '\\u', '\\\\u') AS text FROM t""",
)
def escape_sql_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents in which every e is an apostrophe and every o a backslash."""
    text = F.translate("text", "eo", "'\\")
    return inp.read_documents(spark, sf_dir).select(
        "doc_id", tx.escape_sql_text(text).alias("text")
    )


@query(
    "path_parts",
    """WITH p AS (
  SELECT page_id, '/corpus/' || regexp_replace(url, '^https?://', '') || '.page.MD' AS path
  FROM pages)
SELECT page_id, path, string_split(path, '/')[-1] AS name, '.MD' AS extension,
  string_split(path, '/')[3] AS repo FROM p""",
)
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat(
        F.lit("/corpus/"), F.regexp_replace("url", "^https?://", ""), F.lit(".page.MD")
    )
    return inp.read(spark, sf_dir, "pages").select("page_id", path.alias("path")).select(
        "page_id",
        "path",
        tx.basename(F.col("path")).alias("name"),
        tx.extension(F.col("path")).alias("extension"),
        tx.repo_of(F.col("path"), "/corpus").alias("repo"),
    )


@query(
    "hash_ids",
    f"WITH {inp.DOC_FILES} SELECT doc_id, sha256(filepath) AS document_id, "
    "sha256(document_text) AS text_id FROM doc_files",
)
def hash_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.doc_files(spark, sf_dir).select(
        "doc_id",
        tx.sha256_hex(F.col("filepath")).alias("document_id"),
        tx.sha256_hex(F.col("document_text")).alias("text_id"),
    )


def _name_of(key: Column) -> Column:
    """One of the strategy names in lower case, an unknown one or none, by key."""
    names = [F.lit(s.lower()) for s in st.STRATEGIES] + [F.lit("by_line"), F.lit(None)]
    return F.get(F.array(*names), (key % len(names)).cast("int"))


_NAME_SQL = "[{}, 'by_line', NULL][p_partkey % {} + 1]".format(
    ", ".join(f"'{s.lower()}'" for s in st.STRATEGIES), len(st.STRATEGIES) + 2
)
_RESOLVED_SQL = (
    "CASE WHEN upper(name) IN ({}) THEN upper(name) "
    "ELSE 'RECURSIVE_CHARACTER_TEXT_SPLITTING' END".format(
        ", ".join(f"'{s}'" for s in st.STRATEGIES)
    )
)


@query(
    "strategy_resolve",
    f"""WITH p AS (SELECT p_partkey, {_NAME_SQL} AS name FROM part)
SELECT p_partkey, {_RESOLVED_SQL} AS strategy FROM p""",
)
def strategy_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inp.read(spark, sf_dir, "part").select(
        "p_partkey", st.resolve_column(_name_of(F.col("p_partkey"))).alias("strategy")
    )


@query(
    "strategy_label",
    f"""WITH p AS (SELECT p_partkey, p_size, {_NAME_SQL} AS name FROM part),
r AS (SELECT p_partkey, p_size, {_RESOLVED_SQL} AS s FROM p)
SELECT p_partkey, CASE s WHEN 'BY_PARAGRAPH' THEN 'By paragraph'
  WHEN 'BY_SENTENCE' THEN 'By sentence'
  WHEN 'BY_SENTENCE_WITH_SLIDING_WINDOW'
    THEN format('By {{}} sentences with a sliding window', p_size + 1)
  WHEN 'EVERY_N_WORDS' THEN format('Every {{}} words', p_size * 10)
  WHEN 'RECURSIVE_CHARACTER_TEXT_SPLITTING' THEN format('Recursive character text splitting '
    || 'with chunk size = {{}} and chunk overlap = {{}}', p_size * 20, p_size)
  ELSE 'Semantic chunking' END AS label FROM r""",
)
def strategy_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    name = st.resolve_column(_name_of(F.col("p_partkey")))
    return inp.read(spark, sf_dir, "part").select(
        "p_partkey", st.label_column(name, size * 20, size, size * 10, size + 1).alias("label")
    )


@query(
    "cache_name",
    """SELECT page_id, 'embeddings_' || regexp_replace(url, '[^\\p{L}\\p{N}_\\-]', '_', 'g')
  || '_Every_100_words.json' AS file_name FROM pages""",
)
def cache_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = tx.cache_name(F.col("url"), F.lit("Every 100 words"), "json")
    return inp.read(spark, sf_dir, "pages").select("page_id", name.alias("file_name"))
