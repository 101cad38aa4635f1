"""Registered queries for text retrieval and checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelgrid.operators import retrieval
from panelgrid.operators import text as op
from panelgrid.plans.registry import query, rd

LIN = r"""ln AS (SELECT doc_id, text, CASE WHEN p[-1] = '' THEN p[:-2] ELSE p END AS p FROM (SELECT doc_id, text, regexp_split_to_array(text, '\r\n|\n|\r') AS p FROM marked) q),
    li_ AS (SELECT doc_id, unnest(p) AS line, unnest(range(0, len(p))) AS pos FROM ln)"""
MARKED = "marked AS (SELECT doc_id, 'opening words' || chr(10) || '# ' || lang || chr(10) || text || chr(10) || '## ' || source || chr(10) || text || chr(10) || '# end' || chr(10) || 'closing words' AS text FROM documents)"


def marked(b):
    """Documents as markdown: an opening, a language heading, the text, a source heading, the text, an end."""
    nl = F.lit("\n")
    parts = [F.lit("opening words"), nl, F.lit("# "), "lang", nl, "text", nl, F.lit("## "), "source", nl, "text", nl, F.lit("# end"), nl, F.lit("closing words")]
    return b("documents").select("doc_id", F.concat(*parts).alias("text"))


SECT = r"""hd AS (SELECT *, length(regexp_extract(line, '^(#{1,6})\s+(.*)$', 1)) AS lv, trim(regexp_extract(line, '^(#{1,6})\s+(.*)$', 2)) AS ti FROM li_),
    pt AS (SELECT *, count(CASE WHEN lv > 0 THEN 1 END) OVER w AS section_no, """ + ", ".join(
    f"last_value(CASE WHEN lv > 0 AND lv <= {n} THEN {{'lv': lv, 'ti': ti}} END IGNORE NULLS) OVER w AS h{n}" for n in range(1, 7)) + r""" FROM hd WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    pp AS (SELECT doc_id, section_no, pos, line, concat_ws(' > ', """ + ", ".join(f"CASE WHEN h{n}.lv = {n} THEN h{n}.ti END" for n in range(1, 7)) + r""") AS path FROM pt WHERE lv = 0),
    se AS (SELECT doc_id, section_no, CASE WHEN any_value(path) = '' THEN CAST(doc_id AS VARCHAR) ELSE any_value(path) END AS heading_path, CASE WHEN any_value(path) = '' THEN CAST(doc_id AS VARCHAR) ELSE string_split(any_value(path), ' > ')[-1] END AS section, regexp_replace(regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^\s+', ''), '\s+$', '') AS body FROM pp GROUP BY 1, 2)"""


@query("m1_sections", f"WITH {MARKED}, {LIN}, {SECT} SELECT doc_id, section_no, heading_path, section, length(body) AS n_chars, md5(body) AS body_hash FROM se")
def _(b):
    return op.sections(marked(b)).select("doc_id", "section_no", "heading_path", "section", F.length("body").cast("bigint").alias("n_chars"), F.md5("body").alias("body_hash"))


CHUNKS = r"""pw AS (SELECT doc_id, section_no, heading_path, section, list_filter(list_transform(string_split(body, chr(10) || chr(10)), lambda p: list_filter(regexp_split_to_array(p, '\s+'), lambda w: w <> '')), lambda w: len(w) > 0) AS ps FROM se),
    pf AS (SELECT doc_id, section_no, heading_path, section, list_reduce(list_transform(ps, lambda w: {'done': CAST([] AS VARCHAR[]), 'held': w}),
      lambda a, b: CASE WHEN len(a.held) + len(b.held) > 512 THEN {'done': list_append(a.done, array_to_string(a.held, ' ')), 'held': list_concat(a.held[-64:], b.held)} ELSE {'done': a.done, 'held': list_concat(a.held, b.held)} END) AS f FROM pw WHERE len(ps) > 0),
    ch AS (SELECT doc_id, section_no, heading_path, section, list_append(f.done, array_to_string(f.held, ' ')) AS cs FROM pf)"""


@query("m2_chunks", f"WITH {MARKED}, {LIN}, {SECT}, {CHUNKS} SELECT doc_id, section_no, heading_path, section, CAST(i - 1 AS INT) AS chunk_no, len(string_split(cs[i], ' ')) AS n_words, md5(cs[i]) AS text_hash FROM (SELECT *, unnest(generate_series(1, len(cs))) AS i FROM ch) q")
def _(b):
    out = op.chunk(op.sections(marked(b)))
    return out.select("doc_id", "section_no", "heading_path", "section", "chunk_no", F.size(F.split("text", " ")).cast("bigint").alias("n_words"), F.md5("text").alias("text_hash"))


TOK = r"string_split(regexp_replace(lower(text), '[^\p{L}\p{N}]+', ' ', 'g'), ' ')"
POST = f"po AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({TOK}) AS term FROM documents) q WHERE term <> '' GROUP BY 1, 2)"


@query("m3_tokens", f"WITH {POST} SELECT doc_id, term, tf FROM po")
def _(b):
    return op.postings(b("documents"), "doc_id")


def bm25_sql(out: str, b: float, k: int) -> str:
    return f"""{out}_s AS (SELECT q.item_id, p.doc_id, {rd(f"sum(q.qtf * w.idf2 * (p.tf * 2.5::DOUBLE) / (p.tf + 1.5::DOUBLE * (1 - {b}::DOUBLE + {b}::DOUBLE * l.dl / c.avgdl)))", 6)} AS score FROM qt q JOIN w ON w.term = q.term JOIN po p ON p.term = q.term JOIN dl l ON l.doc_id = p.doc_id, c GROUP BY 1, 2),
    {out} AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank FROM {out}_s WHERE score > 0) z WHERE rank <= {k})"""


BM = f"""{POST}, dl AS (SELECT d.doc_id, coalesce(sum(p.tf), 0) AS dl FROM documents d LEFT JOIN po p ON p.doc_id = d.doc_id GROUP BY 1), c AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl), f AS (SELECT term, count(*) AS df FROM po GROUP BY 1), i AS (SELECT term, ln(c.n - df + 0.5::DOUBLE) - ln(df + 0.5::DOUBLE) AS idf FROM f, c),
    w AS (SELECT term, CASE WHEN idf < 0 THEN (SELECT avg(idf) * 0.25::DOUBLE FROM i) ELSE idf END AS idf2 FROM i), qt AS (SELECT item_id, term, count(*) AS qtf FROM (SELECT item_id, unnest({TOK}) AS term FROM benchmark) q WHERE term <> '' GROUP BY 1, 2)"""


def documents_index(b) -> retrieval.Index:
    """The index of the documents, built once for all queries that search it."""
    docs = b("documents")
    rows = b.kept_table("postings", lambda: retrieval.store_postings(retrieval.impact_postings(docs)))
    blocks = b.kept("blocks", lambda: retrieval.impact_blocks(rows))
    return retrieval.Index(rows, blocks, b.kept("corpus", lambda: retrieval.corpus_numbers(docs, blocks)))


@query("m4_bm25", f"WITH {BM}, {bm25_sql('r', 0.75, 10)} SELECT * FROM r")
def _(b):
    return retrieval.search(b("benchmark"), documents_index(b), 10)


CEN = "ce AS (SELECT label, list(m ORDER BY i) AS embedding FROM (SELECT label, i, avg(x) AS m FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) q GROUP BY 1, 2) z GROUP BY 1)"


def centroids(b):
    rows = b("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    return rows.groupBy("label").agg(F.sort_array(F.collect_list(F.struct("i", "m"))).alias("s")).select("label", F.transform("s", lambda x: x["m"]).alias("embedding"))


@query("m5_dense_topk", f"""WITH {CEN}, s AS (SELECT c.label, e.vec_id, {rd('list_cosine_similarity(c.embedding, e.embedding::DOUBLE[])', 8)} AS score FROM ce c, embeddings e)
    SELECT label, vec_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rank FROM s) q WHERE rank <= 10""")
def _(b):
    return op.dense_topk(centroids(b), b("embeddings").select("vec_id", "embedding"), 10, "label", "vec_id")


# A document and an item have the vector whose id is theirs, by convention.
DENSE = f"""qv AS (SELECT item_id, e.embedding::DOUBLE[] AS v FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id), dv AS (SELECT doc_id, e.embedding::DOUBLE[] AS v FROM documents d JOIN embeddings e ON e.vec_id = d.doc_id),
    ds AS (SELECT item_id, doc_id, {rd('list_cosine_similarity(q.v, d.v)', 8)} AS score FROM qv q, dv d), r2 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM ds) z WHERE rank <= 40)"""


@query("m6_rrf", f"""WITH {BM}, {bm25_sql('r1', 0.75, 40)}, {DENSE}, fu AS (SELECT item_id, doc_id, {rd('sum(1.0::DOUBLE / (60 + rank))', 12)} AS score FROM (SELECT item_id, doc_id, rank FROM r1 UNION ALL SELECT item_id, doc_id, rank FROM r2) q GROUP BY 1, 2)
    SELECT item_id, doc_id, score, CAST(rank AS INT) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM fu) z WHERE rank <= 10""")
def _(b):
    q, d, e = b("benchmark"), b("documents"), b("embeddings").select("vec_id", "embedding")
    asked = q.select(F.col("item_id"), F.col("item_id").alias("vec_id")).join(e, "vec_id").select("item_id", "embedding")
    known = d.select(F.col("doc_id").alias("vec_id")).join(e, "vec_id").withColumnRenamed("vec_id", "doc_id")
    return op.rrf([retrieval.search(q, documents_index(b), 40), op.dense_topk(asked, known, 40, "item_id", "doc_id")], "item_id", "doc_id", 10)


def cited(b):
    """Texts that cite their source and a numbered study."""
    return b("documents").select(F.col("doc_id").alias("text_id"), F.concat("text", F.lit(" ["), F.upper("source"), F.lit("  data] and [study "), (F.col("doc_id") % 9).cast("string"), F.lit("]")).alias("text"))


def known_keys(b):
    return b("documents").select(F.explode(F.array(F.concat("source", F.lit(" data")), F.concat(F.lit("Study "), (F.col("doc_id") % 4).cast("string")))).alias("key")).distinct()


def cleaned(c: str) -> str:
    return f"regexp_replace(lower(trim({c})), '\\s+', ' ', 'g')"


KNOWN = f"known AS (SELECT DISTINCT {cleaned('key')} AS key FROM (SELECT source || ' data' AS key FROM documents UNION ALL SELECT 'Study ' || CAST(doc_id % 4 AS VARCHAR) FROM documents) q)"
CITED = r"""cited AS (SELECT doc_id AS text_id, text || ' [' || upper(source) || '  data] and [study ' || CAST(doc_id % 9 AS VARCHAR) || ']' AS text FROM documents),
    cites AS (SELECT text_id, unnest(regexp_extract_all(text, '\[([^\[\]]+)\]', 1)) AS citation FROM cited)"""


@query("m7_check_citations", f"WITH {KNOWN}, {CITED} SELECT text_id, citation FROM cites WHERE {cleaned('citation')} NOT IN (SELECT key FROM known)")
def _(b):
    return op.check_citations(cited(b), known_keys(b))


@query("m8_check_numbers", r"""WITH texts AS (SELECT o_orderkey AS text_id, o_totalprice, 'Total ' || printf('%.1f', round(o_totalprice, 1)) || ' in 1998 for ACH-000444, up 12.5% not 1,000,000.5 [ref 7 2024]; 3 items or 77%' AS text FROM orders),
    words AS (SELECT text_id, unnest(w) AS word, unnest(range(0, len(w))) AS i FROM (SELECT text_id, string_split(regexp_replace(text, '\[[^\[\]]+\]', ' ', 'g'), ' ') AS w FROM texts) q),
    found AS (SELECT text_id, rtrim(word, ',;') AS token, CAST(row_number() OVER (PARTITION BY text_id ORDER BY i) - 1 AS INT) AS pos FROM words WHERE regexp_full_match(rtrim(word, ',;'), '-?\d[\d,]*(\.\d+)?%?')),
    nums AS (SELECT *, replace(replace(token, '%', ''), ',', '') AS plain FROM found),
    vals AS (SELECT text_id, pos, token, CAST(plain AS DOUBLE) / CASE WHEN token LIKE '%\%' ESCAPE '\' THEN 100 ELSE 1 END AS value, length(regexp_extract(plain, '\.(\d+)$', 1)) AS decimals FROM nums WHERE NOT regexp_full_match(plain, '(19|20)\d{2}')),
    facts AS (SELECT text_id, unnest([o_totalprice, 0.125, 2.6]) AS fact FROM texts)
    SELECT text_id, pos, token FROM vals v WHERE NOT EXISTS (SELECT 1 FROM facts f WHERE f.text_id = v.text_id AND CAST(round(f.fact * pow(10, v.decimals)) AS DECIMAL(38, 0)) = CAST(round(v.value * pow(10, v.decimals)) AS DECIMAL(38, 0)))""")
def _(b):
    o = b("orders")
    total = F.format_string("%.1f", F.col("o_totalprice"))
    text = F.concat(F.lit("Total "), total, F.lit(" in 1998 for ACH-000444, up 12.5% not 1,000,000.5 [ref 7 2024]; 3 items or 77%"))
    facts = o.select(F.col("o_orderkey").alias("text_id"), F.explode(F.array(F.col("o_totalprice"), F.lit(0.125), F.lit(2.6))).alias("fact"))
    return op.check_numbers(o.select(F.col("o_orderkey").alias("text_id"), text.alias("text")), facts)


RULES = [(r"\bthe end\.md\b", "the closing record"), (r"\bde la\b", "the project guide"), (r"\b(the|le)\b", "<article>"), (r"\b[a-z]+\.md\b", "the documentation")]


def replaced(text: str, words: str, by: str) -> str:
    """Whole words replaced; letters of any script are part of a word. Twice, as neighbours share what stands between them."""
    for _ in range(2):
        text = f"regexp_replace({text}, '(^|[^\\p{{L}}\\p{{N}}_])({words})($|[^\\p{{L}}\\p{{N}}_])', '\\1{by}\\3', 'g')"
    return text


SANITISED = "text || ' see the end.md or notes.md'"
for _words, _by in (("the end\\.md", "the closing record"), ("de la", "the project guide"), ("the|le", "<article>"), ("[a-z]+\\.md", "the documentation")):
    SANITISED = replaced(SANITISED, _words, _by)


@query("m9_sanitise", f"SELECT doc_id, md5({SANITISED}) AS h FROM documents")
def _(b):
    docs = b("documents").select("doc_id", F.concat("text", F.lit(" see the end.md or notes.md")).alias("text"))
    return op.sanitise(docs, RULES).select("doc_id", F.md5("text").alias("h"))


@query("m10_gate_report", f"""WITH g AS (SELECT 'citation_resolution' AS gate, doc_id % 9 <= 3 AS passed FROM documents UNION ALL SELECT 'refusal', regexp_matches(lower(text), '{"|".join(x.replace("'", "''") for x in op.ABSTENTION)}') FROM (SELECT text || CASE WHEN turn % 2 = 0 THEN ' There is No Evidence.' ELSE '' END AS text FROM conversations) q)
    SELECT gate, count(*) AS n_items, count(CASE WHEN passed THEN 1 END) AS n_passed, round(CAST(count(CASE WHEN passed THEN 1 END) AS DOUBLE) / count(*), 6) AS fraction_passed FROM g GROUP BY 1""")
def _(b):
    texts = cited(b)
    failed = op.check_citations(texts, known_keys(b)).select("text_id").distinct().withColumn("_f", F.lit(True))
    first = texts.select("text_id").join(failed, "text_id", "left").select(F.lit("citation_resolution").alias("gate"), F.col("_f").isNull().alias("passed"))
    answers = b("conversations").select(F.concat("text", F.when(F.col("turn") % 2 == 0, " There is No Evidence.").otherwise("")).alias("text"))
    return op.gate_report(first.unionByName(answers.select(F.lit("refusal").alias("gate"), op.looks_abstaining("text").alias("passed"))))


@query("m11_registry", f"""WITH texts AS (SELECT doc_id, 'intro' || chr(10) || '| Paper | Use |' || chr(10) || '|---|---|' || chr(10) || '| **Method** (Okafor et al. ' || CAST(1990 + doc_id % 30 AS VARCHAR) || ') | x |' || chr(10) || chr(10) || '| Location | Note |' || chr(10) || '|:--|--|' || chr(10) || '| `' || upper(source) || '  files` | y |' || chr(10) || 'plain text (Other 2000)' AS text FROM documents),
    mli AS (SELECT doc_id, unnest(l) AS line, unnest(range(0, len(l))) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM texts) q),
    mta AS (SELECT doc_id, pos, line, list_transform(string_split(regexp_replace(regexp_replace(line, '^\\|+', ''), '\\|+\\s*$', ''), '|'), lambda x: trim(x)) AS cells FROM mli WHERE regexp_full_match(line, '\\|.+\\|\\s*')),
    mbl AS (SELECT *, pos - row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS block, len(list_filter(cells, lambda x: NOT regexp_full_match(x, '(:?-+:?)?'))) = 0 AS divider FROM mta),
    mhd AS (SELECT doc_id, block, min(pos) FILTER (divider) AS at, arg_min(lower(cells[1]), pos) AS head FROM mbl GROUP BY 1, 2),
    mro AS (SELECT b.*, h.head = 'location' AND b.pos > h.at AS in_location FROM mbl b JOIN mhd h ON h.doc_id = b.doc_id AND h.block = b.block WHERE NOT divider),
    mpa AS (SELECT doc_id, unnest(regexp_extract_all(array_to_string(cells, ' | '), '\\([A-Z][A-Za-z-]+[^()]*?\\s\\d{{4}}\\)')) AS m FROM mro)
    SELECT DISTINCT doc_id, 'paper' AS kind, {cleaned("regexp_extract(m, '^.([A-Za-z-]+)', 1) || ' ' || regexp_extract(m, '([0-9]+).$', 1)")} AS key FROM mpa UNION
    SELECT DISTINCT doc_id, 'data_source', {cleaned("trim(cells[1], '`')")} FROM mro WHERE in_location AND len(cells) >= 2""")
def _(b):
    row = F.concat(F.lit("intro\n| Paper | Use |\n|---|---|\n| **Method** (Okafor et al. "), (F.lit(1990) + F.col("doc_id") % 30).cast("string"), F.lit(") | x |\n\n| Location | Note |\n|:--|--|\n| `"), F.upper("source"), F.lit("  files` | y |\nplain text (Other 2000)"))
    return op.registry(b("documents").select("doc_id", row.alias("text")))


@query("m12_missing_provenance", f"""WITH {KNOWN}, sg AS (SELECT doc_id AS suggestion_id, CASE doc_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'unknown place' ELSE upper(source) || ' data' END AS provenance FROM documents)
    SELECT suggestion_id, provenance, CASE WHEN trim(coalesce(provenance, '')) = '' THEN 'missing' ELSE 'unresolved' END AS problem FROM sg WHERE trim(coalesce(provenance, '')) = '' OR {cleaned('provenance')} NOT IN (SELECT key FROM known)""")
def _(b):
    provenance = F.when(F.col("doc_id") % 3 == 0, F.lit(None)).when(F.col("doc_id") % 3 == 1, "unknown place").otherwise(F.concat(F.upper("source"), F.lit(" data")))
    rows = b("documents").select(F.col("doc_id").alias("suggestion_id"), provenance.alias("provenance"))
    return op.missing_provenance(rows, known_keys(b))
