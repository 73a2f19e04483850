"""DuckDB statements with the expected result of each registered query.

Results over the derived Java corpus are written from the relational tables the files came
from: nothing here parses a file.
"""

from __future__ import annotations

import zipfile
from functools import cache
from pathlib import Path

from codequarry.functions.constants import COMMON_TYPES, EDGE_TEXT, PROMPT_HEAD, PROMPT_TAIL
from codequarry.sources import corpus as C

SPACES = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
WORDS = r"'[\p{L}\p{N}_]{2,}'"
NL = "chr(10)"


@cache
def _stop_words() -> str:
    """The stop words Spark ships, read from its jar so that no session is needed."""
    import pyspark

    jars = sorted(Path(pyspark.__file__).parent.glob("jars/spark-mllib_*.jar"))
    if jars:
        with zipfile.ZipFile(jars[0]) as jar:
            words = jar.read("org/apache/spark/ml/feature/stopwords/english.txt").decode().split("\n")
    else:
        from codequarry.functions.constants import english_stop_words

        words = english_stop_words()
    return ", ".join("'" + w.strip().replace("'", "''") + "'" for w in words if w.strip())


def folder_tree(files: str) -> str:
    """Every file and folder of a table of files, with the number of files below and the sum of their hashes."""
    return f"""{files}_tree AS (SELECT CAST(i AS INT) AS level, array_to_string(parts[1:i], '/') AS path, i = len(parts) AS is_file,
  count(*) AS n_files, CAST(sum(('0x' || substr(hash, 1, 12))::BIGINT) AS VARCHAR) AS digest
FROM (SELECT string_split(path, '/') AS parts, md5(concat_ws('::', path, content_md5)) AS hash FROM {files}),
  unnest(range(0, len(parts) + 1)) AS t(i) GROUP BY ALL)"""


def _with(*ctes: str, body: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + body


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _clean(x: str) -> str:
    flat = f"trim(regexp_replace({x}, '[ \\t\\n\\v\\f\\r]+', ' ', 'g'), {SPACES})"
    return f"replace(replace(replace({flat}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


# ---- documents -------------------------------------------------------------------------

def sents() -> str:
    return f"""sents AS MATERIALIZED (
  SELECT doc_id, n_sent, CAST(ord - 1 AS INTEGER) AS sent_id, sentence FROM (
    SELECT doc_id, CAST(len(l) AS INTEGER) AS n_sent, unnest(l) AS sentence, generate_subscripts(l, 1) AS ord FROM (
      SELECT doc_id, list_filter(list_transform(
        string_split_regex(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)),
        lambda x: trim(x, {SPACES})), lambda x: x <> '') AS l FROM documents)))"""


def toks() -> str:
    return f"""toks AS MATERIALIZED (
  SELECT doc_id, n_sent, sent_id, term FROM (
    SELECT doc_id, n_sent, sent_id, unnest(regexp_extract_all(lower(sentence), {WORDS})) AS term FROM sents)
  WHERE term NOT IN ({_stop_words()}))"""


def weights() -> list[str]:
    return [
        sents(),
        toks(),
        "tf AS (SELECT doc_id, sent_id, n_sent, term, count(*) AS tf FROM toks GROUP BY ALL)",
        "raw AS (SELECT *, tf * (ln((1 + n_sent) / (1 + count(*) OVER (PARTITION BY doc_id, term))) + 1) AS r FROM tf)",
        "w AS MATERIALIZED (SELECT doc_id, sent_id, term, r / sqrt(sum(r * r) OVER (PARTITION BY doc_id, sent_id)) AS w FROM raw)",
    ]


def kmeans(k: int, steps: int = 5) -> list[str]:
    out = [
        "s AS MATERIALIZED (SELECT doc_id, sent_id, row_number() OVER (PARTITION BY doc_id ORDER BY sent_id) - 1 AS i,"
        " count(*) OVER (PARTITION BY doc_id) AS n FROM (SELECT DISTINCT doc_id, sent_id FROM w))",
        f"""c0 AS MATERIALIZED (SELECT w.doc_id, c, term, w FROM s
  JOIN range(0, {k}) t(c) ON c < least({k}, n) AND i = floor((c + 0.5) * n / least({k}, n))
  JOIN w ON w.doc_id = s.doc_id AND w.sent_id = s.sent_id)""",
    ]
    for j in range(steps + 1):
        out.append(f"""d{j} AS MATERIALIZED (
  SELECT s.doc_id, s.sent_id, q.c, round(1 + q.q - 2 * coalesce(x.dot, 0), 9) AS d
  FROM s JOIN (SELECT doc_id, c, sum(w * w) AS q FROM c{j} GROUP BY ALL) q ON q.doc_id = s.doc_id
  LEFT JOIN (SELECT w.doc_id, w.sent_id, k.c, sum(w.w * k.w) AS dot FROM w JOIN c{j} k
             ON k.doc_id = w.doc_id AND k.term = w.term GROUP BY ALL) x
  ON x.doc_id = s.doc_id AND x.sent_id = s.sent_id AND x.c = q.c)""")
        out.append(f"""l{j} AS MATERIALIZED (SELECT doc_id, sent_id, c FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY d, c) AS rn FROM d{j}) WHERE rn = 1)""")
        if j < steps:
            out.append(f"""c{j + 1} AS MATERIALIZED (
  SELECT l.doc_id, l.c, w.term, sum(w.w) / any_value(m.n) AS w FROM l{j} l
  JOIN (SELECT doc_id, c, count(*) AS n FROM l{j} GROUP BY ALL) m ON m.doc_id = l.doc_id AND m.c = l.c
  JOIN w ON w.doc_id = l.doc_id AND w.sent_id = l.sent_id GROUP BY l.doc_id, l.c, w.term
  UNION ALL
  SELECT c.doc_id, c.c, c.term, c.w FROM c{j} c ANTI JOIN l{j} l ON l.doc_id = c.doc_id AND l.c = c.c)""")
    out.append(f"""medoid AS MATERIALIZED (SELECT doc_id, c, sent_id FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY d, sent_id) AS rn FROM d{steps}) WHERE rn = 1)""")
    out.append("""tscore AS MATERIALIZED (SELECT m.doc_id, m.c, b.sent_id, round(sum(a.w * b.w), 9) AS score
  FROM medoid m JOIN w a ON a.doc_id = m.doc_id AND a.sent_id = m.sent_id
  JOIN w b ON b.doc_id = m.doc_id AND b.term = a.term GROUP BY ALL)""")
    out.append("""keys AS MATERIALIZED (SELECT doc_id, c, sent_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id, c ORDER BY score DESC, sent_id) AS rn FROM tscore) WHERE rn = 1)""")
    return out


def corpus_kmeans(k: int = 3, steps: int = 5) -> list[str]:
    """All sentences as one text: ``l<steps>(doc_id, sent_id, c)``."""
    out = [
        sents(),
        toks(),
        "tf AS MATERIALIZED (SELECT doc_id, sent_id, term, count(*) AS tf FROM toks GROUP BY ALL)",
        "s AS MATERIALIZED (SELECT DISTINCT doc_id, sent_id FROM tf)",
        "idf AS (SELECT term, ln((1 + (SELECT count(*) FROM s)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY term)",
        "w AS MATERIALIZED (SELECT doc_id, sent_id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY doc_id, sent_id)) AS w FROM tf JOIN idf USING (term))",
        f"st AS (SELECT *, row_number() OVER (ORDER BY md5(doc_id || ':' || sent_id), doc_id, sent_id) - 1 AS c FROM s QUALIFY c < {k})",
        "c0 AS MATERIALIZED (SELECT c, term, w FROM st JOIN w USING (doc_id, sent_id))",
    ]
    for j in range(steps + 1):
        out.append(f"""l{j} AS MATERIALIZED (SELECT doc_id, sent_id, c FROM (
  SELECT s.doc_id, s.sent_id, q.c, round(1 + q.q - 2 * coalesce(x.dot, 0), 9) AS d
  FROM s CROSS JOIN (SELECT c, sum(w * w) AS q FROM c{j} GROUP BY c) q
  LEFT JOIN (SELECT w.doc_id, w.sent_id, k.c, sum(w.w * k.w) AS dot FROM w JOIN c{j} k USING (term) GROUP BY ALL) x
  ON x.doc_id = s.doc_id AND x.sent_id = s.sent_id AND x.c = q.c)
  QUALIFY row_number() OVER (PARTITION BY doc_id, sent_id ORDER BY d, c) = 1)""")
        if j < steps:
            out.append(f"""c{j + 1} AS MATERIALIZED (
  SELECT l.c, w.term, sum(w.w) / any_value(m.n) AS w FROM l{j} l
  JOIN (SELECT c, count(*) AS n FROM l{j} GROUP BY c) m USING (c) JOIN w USING (doc_id, sent_id) GROUP BY l.c, w.term
  UNION ALL SELECT c.c, c.term, c.w FROM c{j} c ANTI JOIN l{j} l ON l.c = c.c)""")
    return out


def _uniform(*before: object) -> str:
    parts = " || ':' || ".join([*map(str, before), "doc_id", "sent_id"])
    return f"((('0x' || substr(md5({parts}), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496::DOUBLE)"


def seeded_kmeans(k: int = 3, steps: int = 5, starts: int = 2, rounds: int = 2, oversample: int = 2) -> list[str]:
    """Several starts at once: ``l<steps>(start, doc_id, sent_id, c, d)`` and ``best(start)``."""
    nano = "greatest(0, CAST(round((2 - 2 * coalesce(dot, 0)) * 1e9::DOUBLE) AS BIGINT))"
    out = corpus_kmeans(k, 0)[:7]
    out.append(f"""q0 AS MATERIALIZED (SELECT r, 0 AS t, doc_id, sent_id FROM s, range(1, {starts + 1}) x(r)
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY md5(r || ':0:' || doc_id || ':' || sent_id), doc_id, sent_id) = 1)""")
    for t in range(rounds + 1):
        out.append(f"""near{t} AS MATERIALIZED (SELECT q.r, s.doc_id, s.sent_id, q.t, q.doc_id AS qd, q.sent_id AS qs, {nano} AS d
  FROM s CROSS JOIN q{t} q LEFT JOIN (
    SELECT q.r, q.doc_id AS qd, q.sent_id AS qs, b.doc_id, b.sent_id, sum(a.w * b.w) AS dot
    FROM q{t} q JOIN w a USING (doc_id, sent_id) JOIN w b ON b.term = a.term GROUP BY ALL) x
  ON x.r = q.r AND x.qd = q.doc_id AND x.qs = q.sent_id AND x.doc_id = s.doc_id AND x.sent_id = s.sent_id
  QUALIFY row_number() OVER (PARTITION BY q.r, s.doc_id, s.sent_id ORDER BY {nano}, q.t, q.doc_id, q.sent_id) = 1)""")
        if t < rounds:
            out.append(f"""q{t + 1} AS MATERIALIZED (FROM q{t} UNION ALL SELECT r, {t + 1}, doc_id, sent_id FROM near{t}
  JOIN (SELECT r, sum(d)::DOUBLE AS phi FROM near{t} GROUP BY r) USING (r) WHERE {_uniform("r", f"'{t + 1}'")} * phi < {oversample * k} * d)""")
    out.append(f"""cand AS MATERIALIZED (SELECT q.r, q.t, q.doc_id, q.sent_id, coalesce(held, 0) AS held,
    row_number() OVER (PARTITION BY q.r ORDER BY q.t, q.doc_id, q.sent_id) AS n
  FROM q{rounds} q LEFT JOIN (SELECT r, qd, qs, count(*) AS held FROM near{rounds} GROUP BY ALL) m ON m.r = q.r AND qd = q.doc_id AND qs = q.sent_id)""")
    out.append(f"""apart AS MATERIALIZED (SELECT a.r, a.n AS a, b.n AS b, {nano} AS d FROM cand a JOIN cand b ON b.r = a.r LEFT JOIN (
    SELECT c.r, c.n AS a, e.n AS b, sum(v.w * u.w) AS dot FROM cand c JOIN w v USING (doc_id, sent_id)
    JOIN w u ON u.term = v.term JOIN cand e ON e.r = c.r AND e.doc_id = u.doc_id AND e.sent_id = u.sent_id GROUP BY ALL) x
  ON x.r = a.r AND x.a = a.n AND x.b = b.n)""")
    out.append("p0 AS (SELECT 0 AS r, 0 AS n, 0 AS c, CAST(0 AS BIGINT) AS doc_id, 0 AS sent_id WHERE false)")
    for j in range(k):
        mass = f"held * coalesce((SELECT min(d) FROM apart JOIN p{j} p ON p.r = apart.r AND p.n = apart.b WHERE apart.r = cand.r AND apart.a = cand.n), {0 if j else 1})"
        out.append(f"""p{j + 1} AS MATERIALIZED (FROM p{j} UNION ALL SELECT r, n, {j}, doc_id, sent_id FROM (SELECT *, {mass} AS mass FROM cand) WHERE mass > 0
  QUALIFY row_number() OVER (PARTITION BY r ORDER BY -ln({_uniform("r", f"'p{j}'")}) / mass, n) = 1)""")
    out.append(f"""k0 AS MATERIALIZED (SELECT 0 AS start, c, term, w FROM st JOIN w USING (doc_id, sent_id)
  UNION ALL SELECT r, c, term, w FROM p{k} JOIN w USING (doc_id, sent_id))""")
    for j in range(steps + 1):
        out.append(f"""l{j} AS MATERIALIZED (SELECT start, doc_id, sent_id, c, d FROM (
  SELECT q.start, s.doc_id, s.sent_id, q.c, round(1 + q.q - 2 * coalesce(x.dot, 0), 9) AS d
  FROM s CROSS JOIN (SELECT start, c, sum(w * w) AS q FROM k{j} GROUP BY ALL) q
  LEFT JOIN (SELECT m.start, w.doc_id, w.sent_id, m.c, sum(w.w * m.w) AS dot FROM w JOIN k{j} m USING (term) GROUP BY ALL) x
  ON x.start = q.start AND x.doc_id = s.doc_id AND x.sent_id = s.sent_id AND x.c = q.c)
  QUALIFY row_number() OVER (PARTITION BY start, doc_id, sent_id ORDER BY d, c) = 1)""")
        if j < steps:
            out.append(f"""k{j + 1} AS MATERIALIZED (SELECT l.start, l.c, w.term, sum(w.w) / any_value(m.n) AS w FROM l{j} l
  JOIN (SELECT start, c, count(*) AS n FROM l{j} GROUP BY ALL) m USING (start, c) JOIN w USING (doc_id, sent_id) GROUP BY ALL
  UNION ALL SELECT o.start, o.c, o.term, o.w FROM k{j} o ANTI JOIN l{j} l ON l.start = o.start AND l.c = o.c)""")
    out.append(f"""best AS (SELECT start FROM l{steps} GROUP BY start
  ORDER BY round(sum(CAST(d AS DECIMAL(20, 9))), 4), start LIMIT 1)""")
    return out


def graph_rank(steps: int = 20, damping: float = 0.85, same: float = 0.5) -> list[str]:
    """``gsumm(doc_id, summary)`` from the power iteration of each text's graph of sentences."""
    out = [
        "ws AS MATERIALIZED (SELECT w.*, sum(w) OVER (PARTITION BY doc_id, term) AS along FROM w)",
        """g AS MATERIALIZED (SELECT s.doc_id, s.sent_id, s.n_sent AS n, round(coalesce(x.degree, 1) - 1, 9) AS degree FROM sents s
  LEFT JOIN (SELECT doc_id, sent_id, sum(w * along) AS degree FROM ws GROUP BY ALL) x USING (doc_id, sent_id))""",
        "r0 AS MATERIALIZED (SELECT doc_id, sent_id, 1 / n AS p FROM g)",
    ]
    for j in range(steps):
        out.append(f"""x{j} AS MATERIALIZED (SELECT doc_id, sent_id, n, CASE WHEN degree > 0 THEN p / degree ELSE 0 END AS x,
    coalesce(sum(p) FILTER (degree <= 0) OVER (PARTITION BY doc_id), 0) AS lost FROM g JOIN r{j} USING (doc_id, sent_id))""")
        out.append(f"""r{j + 1} AS MATERIALIZED (SELECT doc_id, sent_id, {1 - damping}::DOUBLE / n + {damping}::DOUBLE * (coalesce(z, 0) - CASE WHEN z IS NULL THEN 0 ELSE x END + lost / n) AS p
  FROM x{j} LEFT JOIN (SELECT w.doc_id, w.sent_id, sum(w.w * y.y) AS z FROM w JOIN (
    SELECT doc_id, term, sum(w * x) AS y FROM w JOIN x{j} USING (doc_id, sent_id) GROUP BY ALL) y USING (doc_id, term) GROUP BY ALL) USING (doc_id, sent_id))""")
    return out + [
        f"""rk AS MATERIALIZED (SELECT doc_id, sent_id, row_number() OVER (PARTITION BY doc_id ORDER BY round(p * n, 9) DESC, sent_id) AS place
  FROM r{steps} JOIN g USING (doc_id, sent_id))""",
        f"""again AS (SELECT DISTINCT doc_id, sent_id FROM (SELECT b.doc_id, b.sent_id, a.sent_id AS other, round(sum(a.w * b.w), 9) AS dot
  FROM w a JOIN w b USING (doc_id, term) WHERE a.sent_id <> b.sent_id GROUP BY ALL)
  JOIN rk USING (doc_id, sent_id) JOIN rk o ON o.doc_id = rk.doc_id AND o.sent_id = other WHERE dot >= {same} AND o.place < rk.place)""",
        """gt AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM (
  SELECT doc_id, sent_id, sentence, place, len(regexp_extract_all(sentence, '[^ \\t\\n\\v\\f\\r]+')) AS words
  FROM sents JOIN rk USING (doc_id, sent_id) ANTI JOIN again USING (doc_id, sent_id)))""",
        """gsumm AS (SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_id) AS summary
  FROM gt WHERE total <= 130 OR total - words < 30 GROUP BY doc_id)""",
    ]


def summary() -> list[str]:
    return [
        """ss AS (SELECT s.doc_id, s.sent_id, s.sentence, coalesce(x.score, 0) AS score,
    len(regexp_extract_all(s.sentence, '[^ \\t\\n\\v\\f\\r]+')) AS words
  FROM sents s LEFT JOIN (
    SELECT doc_id, sent_id, round(sum(w * a), 9) AS score FROM (
      SELECT *, sum(w) OVER (PARTITION BY doc_id, term) AS a FROM w) GROUP BY ALL) x
  ON x.doc_id = s.doc_id AND x.sent_id = s.sent_id)""",
        """st AS (SELECT *, sum(words) OVER (PARTITION BY doc_id ORDER BY score DESC, sent_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS total FROM ss)""",
        """summ AS MATERIALIZED (SELECT doc_id, string_agg(sentence, ' ' ORDER BY sent_id) AS summary
  FROM st WHERE total <= 130 OR total - words < 30 GROUP BY doc_id)""",
    ]


POINTS = """pts AS (SELECT m.doc_id, m.c + 1 AS nth, s.sentence AS point FROM medoid m
  JOIN sents s ON s.doc_id = m.doc_id AND s.sent_id = m.sent_id)"""
TOPICS = """topics AS (SELECT p.doc_id, p.nth, p.point AS topic, s.sentence AS key_sentence
  FROM pts p JOIN keys k ON k.doc_id = p.doc_id AND k.c + 1 = p.nth
  JOIN sents s ON s.doc_id = k.doc_id AND s.sent_id = k.sent_id)"""


# ---- search ----------------------------------------------------------------------------

def text_search(queries: str, texts: str, k: int = 5) -> list[str]:
    """``hits(query_id, rank, id, score)`` of TF-IDF cosine over whole texts."""
    def words(source: str, key: str) -> str:
        return (
            f"SELECT id, term, count(*) AS tf FROM (SELECT {key} AS id, "
            f"unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM {source}) "
            f"WHERE term NOT IN ({_stop_words()}) GROUP BY ALL"
        )
    return [
        f"qs AS MATERIALIZED ({queries})",
        f"ts AS MATERIALIZED ({texts})",
        f"ttf AS MATERIALIZED ({words('ts', 'id')})",
        "idf AS MATERIALIZED (SELECT term, ln((1 + (SELECT count(*) FROM ts)) / (1 + count(*))) + 1 AS idf FROM ttf GROUP BY term)",
        f"qtf AS ({words('qs', 'query_id')})",
        "tw AS MATERIALIZED (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM ttf JOIN idf USING (term))",
        "qw AS MATERIALIZED (SELECT id, term, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM qtf JOIN idf USING (term))",
        f"""hits AS MATERIALIZED (SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM (
    SELECT qw.id AS query_id, tw.id AS id, round(sum(qw.w * tw.w), 9) AS score FROM qw JOIN tw USING (term) GROUP BY ALL))
  WHERE rank <= {k})""",
    ]


BENCH_QUERIES = "SELECT item_id AS query_id, text FROM benchmark"
DOC_TEXTS = "SELECT doc_id AS id, text FROM documents"
LABEL_MEANS = """means AS MATERIALIZED (SELECT label, list(m ORDER BY dim) AS v FROM (
  SELECT label, dim, avg(x) AS m FROM (
    SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL) GROUP BY label)"""


def vector_search(score: str, order: str, k: int) -> list[str]:
    return [
        LABEL_MEANS,
        f"""hits AS MATERIALIZED (SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY {order}, id) AS rank FROM (
    SELECT CAST(m.label AS BIGINT) AS query_id, e.vec_id AS id, round({score}, 9) AS score FROM means m, embeddings e))
  WHERE rank <= {k})""",
    ]


L2 = "list_distance(m.v, e.embedding::DOUBLE[]) ** 2"
COSINE = "list_cosine_similarity(m.v, e.embedding::DOUBLE[])"


def prompts(style: str, shown: str = "SELECT query_id, rank, d.lang AS kind, d.text AS content FROM hits JOIN documents d ON d.doc_id = hits.id") -> list[str]:
    """``prompts_<style>(query_id, prompt)`` from ``hits``, ``qs`` and what a hit shows."""
    head = "kind" if style == "typed" else "'Snippet ' || rank"
    return [
        f"""bodies_{style} AS (SELECT query_id, string_agg({NL} || {head} || ':' || {NL} || content || {NL}, '' ORDER BY rank) AS body
  FROM ({shown}) GROUP BY query_id)""",
        f"""prompts_{style} AS MATERIALIZED (SELECT query_id,
  {_nl(PROMPT_HEAD[0])} || text || {_nl(PROMPT_HEAD[1])} || body || {_nl(PROMPT_TAIL[style])} AS prompt
  FROM qs JOIN bodies_{style} USING (query_id))""",
    ]


def prompt(style: str) -> str:
    return _with(*text_search(BENCH_QUERIES, DOC_TEXTS), *prompts(style), body=f"FROM prompts_{style}")


def _nl(text: str) -> str:
    return "(" + f" || {NL} || ".join(_quoted(p) for p in text.split("\n")) + ")"


# ---- the derived Java corpus -----------------------------------------------------------

def corpus() -> list[str]:
    return [
        f"corpus AS MATERIALIZED ({C.corpus_sql()})",
        """o AS MATERIALIZED (SELECT *, 'src/r' || n_regionkey || '/n' || n_nationkey || '/Order' || o_orderkey || '.java' AS path,
    CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS p
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)""",
        "cu AS (SELECT *, 'src/model/Customer' || c_custkey || '.java' AS path FROM customer)",
        "na AS (SELECT *, 'src/model/Nation' || n_nationkey || '.java' AS path FROM nation)",
        "re AS (SELECT *, 'src/model/Region' || r_regionkey || '.java' AS path FROM region)",
        "gr AS (SELECT *, 'Größe' || r_regionkey || '.java' AS path FROM region)",
        "sta AS (SELECT o_orderstatus, 'src/model/Status' || o_orderstatus || '.java' AS path FROM (SELECT DISTINCT o_orderstatus FROM orders))",
        "su AS (SELECT *, 'src/model/Supplier' || s_suppkey || '.java' AS path FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0)",
        "steps AS MATERIALIZED (SELECT o.*, CAST(i AS INTEGER) AS i FROM o JOIN range(1, 6) t(i) ON i <= p)",
        _types(),
        _members(),
        _decls(),
    ]


def _sql(template: str, columns) -> str:
    return C.sql_concat(template, columns)


def _types() -> str:
    o, k, s, r = C.ORDER_COLUMNS, C.CUSTOMER_COLUMNS, C.SUPPLIER_COLUMNS, {"r": "r_regionkey"}
    order_body = (
        _sql(C.ORDER_FIELDS, o) + " || " + C.order_steps_sql(o, "p") + " || " + _sql("  " + C.INNER + "\n", o)
    )
    supplier_body = _sql(C.SUPPLIER_FIELDS + C.PAY + "\n  " + C.RUN + "\n", s)
    return f"""ty AS MATERIALIZED (
  SELECT path, 'Order' || o_orderkey AS name, 'class' AS kind, 'Customer' || o_custkey AS parent,
    'Status' || o_orderstatus || ', Region' || n_regionkey AS implements, {order_body} AS body, {C.order_class_sql()} AS content, 0 AS depth FROM o
  UNION ALL SELECT path, 'Inner' || o_orderkey, 'class', NULL, NULL, {_sql(' void ping() { owner.notify(1); } ', o)}, {_sql(C.INNER, o)}, 1 FROM o
  UNION ALL SELECT path, 'Customer' || c_custkey, 'class', 'Nation' || c_nationkey, NULL,
    {_sql(chr(10) + '  Nation{n} home;' + chr(10) + '  ' + C.TOUCH + chr(10), k)}, {_sql(C.CUSTOMER, k)}, 0 FROM cu
  UNION ALL SELECT path, 'Nation' || n_nationkey, 'class', NULL, NULL,
    {_sql(chr(10) + '  ' + C.TOUCH + chr(10), k)}, {_sql(C.NATION, {'n': 'n_nationkey'})}, 0 FROM na
  UNION ALL SELECT path, 'Region' || r_regionkey, 'interface', NULL, NULL,
    {_sql(chr(10) + '  String label(int level);' + chr(10), k)}, NULL, 0 FROM re
  UNION ALL SELECT path, 'Größe' || r_regionkey, 'class', 'Über$Basis' || r_regionkey, 'Region' || r_regionkey,
    {_sql(C.SIZE_BODY, r)}, {_sql(C.SIZE_OPEN + C.SIZE_BODY + '}', r)}, 0 FROM gr
  UNION ALL SELECT path, 'Status' || o_orderstatus, 'interface', NULL, NULL,
    {_sql(chr(10) + '  void audit(int level);' + chr(10), k)}, NULL, 0 FROM sta
  UNION ALL SELECT path, 'Supplier' || s_suppkey, 'class', 'Party', 'Region' || n_regionkey,
    {supplier_body}, {_sql(C.SUPPLIER_OPEN, s)} || {supplier_body} || '}}', 0 FROM su)"""


def _members() -> str:
    r = {"r": "r_regionkey"}
    return f"""me AS MATERIALIZED (
  SELECT path, 'Order' || o_orderkey AS type_name, 'field' AS member, 1 AS ordinal, 'Customer' || o_custkey AS field_type, 'owner' AS name,
    'private Customer' || o_custkey || ' owner;' AS text FROM o
  UNION ALL SELECT path, 'Order' || o_orderkey, 'field', 2, 'List', 'tags', 'List<String> tags;' FROM o
  UNION ALL SELECT path, 'Order' || o_orderkey, 'field', 3, 'String', 'label', 'String label = "}} ' || chr(92) || '" {{";' FROM o
  UNION ALL SELECT path, 'Order' || o_orderkey, 'field', 4, 'char', 'q', 'char q = ' || chr(39) || '"' || chr(39) || ';' FROM o
  UNION ALL SELECT path, 'Order' || o_orderkey, 'field', 5, 'char', 'b', 'char b = ' || chr(39) || '{{' || chr(39) || ';' FROM o
  UNION ALL SELECT path, 'Order' || o_orderkey, 'method', i, NULL, 'step' || i,
    'public void step' || i || '(int a) {{ if (a > ' || i || ') {{ Customer' || o_custkey || '.touch(); }} }}' FROM steps
  UNION ALL SELECT path, 'Inner' || o_orderkey, 'method', 1, NULL, 'ping', 'void ping() {{ owner.notify(1); }}' FROM o
  UNION ALL SELECT path, 'Customer' || c_custkey, 'field', 1, 'Nation' || c_nationkey, 'home', 'Nation' || c_nationkey || ' home;' FROM cu
  UNION ALL SELECT path, 'Customer' || c_custkey, 'method', 1, NULL, 'touch', 'public static void touch() {{ }}' FROM cu
  UNION ALL SELECT path, 'Nation' || n_nationkey, 'method', 1, NULL, 'touch', 'public static void touch() {{ }}' FROM na
  UNION ALL SELECT path, 'Region' || r_regionkey, 'method', 1, NULL, 'label', 'String label(int level);' FROM re
  UNION ALL SELECT path, 'Status' || o_orderstatus, 'method', 1, NULL, 'audit', 'void audit(int level);' FROM sta
  UNION ALL SELECT path, 'Supplier' || s_suppkey, 'field', 1, 'List', 'homes', 'List<Nation' || n_nationkey || '> homes;' FROM su
  UNION ALL SELECT path, 'Supplier' || s_suppkey, 'field', 2, 'int', 'sizes', 'int[] sizes = {{1, 2}}' FROM su
  UNION ALL SELECT path, 'Supplier' || s_suppkey, 'field', 3, 'String', 'note',
    'String note = ""\"' || chr(10) || '  {{ "x" }} ""\";' FROM su
  UNION ALL SELECT path, 'Supplier' || s_suppkey, 'method', 1, NULL, 'pay', 'abstract void pay();' FROM su
  UNION ALL SELECT path, 'Supplier' || s_suppkey, 'method', 2, NULL, 'run',
    'void run() {{ Runnable r = () -> {{ Nation' || n_nationkey || '.touch(); }}; new Thread() {{ public void run() {{ }} }}; }}' FROM su
  UNION ALL SELECT path, 'Größe' || r_regionkey, 'field', 1, 'Ann$Type' || r_regionkey, 'ähnlich', {_sql(C.NAMED, r)} FROM gr
  UNION ALL SELECT path, 'Größe' || r_regionkey, 'field', 2, 'Map', 'tief', {_sql(C.DEEP, r)} FROM gr
  UNION ALL SELECT path, 'Größe' || r_regionkey, 'method', 1, NULL, 'öffne', {_sql(C.OPEN_METHOD, r)} FROM gr)"""


def _decls() -> str:
    """Class and method declarations of every depth; ``seq`` sorts them as in the file."""
    return """de AS MATERIALIZED (
  SELECT path, 'class' AS kind, name, depth, CASE WHEN depth = 0 THEN 0 ELSE 100 END AS seq, content FROM ty WHERE kind = 'class'
  UNION ALL SELECT path, 'method', name, CASE WHEN type_name LIKE 'Inner%' THEN 2 ELSE 1 END,
    CASE WHEN type_name LIKE 'Inner%' THEN 101 ELSE ordinal END, text FROM me WHERE member = 'method'
  UNION ALL SELECT path, 'method', 'run', 3, 3, 'public void run() { }' FROM su)"""


PACKAGE_ROWS = """pk AS (
  SELECT path, 'r' || n_regionkey || '.n' || n_nationkey AS package, 'Order' || o_orderkey AS class_name FROM o
  UNION ALL SELECT path, 'model', name FROM ty WHERE path LIKE 'src/model/%')"""
IMPLEMENTS = """im AS (
  SELECT path, 'Order' || o_orderkey AS name, 'Status' || o_orderstatus AS interface FROM o
  UNION ALL SELECT path, 'Order' || o_orderkey, 'Region' || n_regionkey FROM o
  UNION ALL SELECT path, 'Supplier' || s_suppkey, 'Region' || n_regionkey FROM su
  UNION ALL SELECT path, 'Größe' || r_regionkey, 'Region' || r_regionkey FROM gr)"""
CALLS = """ca AS (
  SELECT path, 'Order' || o_orderkey AS caller_type, 'step' || i AS caller_method, 'Customer' || o_custkey AS receiver, 'touch' AS callee, 1 AS nth FROM steps
  UNION ALL SELECT path, 'Inner' || o_orderkey, 'ping', 'owner', 'notify', 1 FROM o
  UNION ALL SELECT path, 'Supplier' || s_suppkey, 'run', 'Nation' || n_nationkey, 'touch', 1 FROM su
  UNION ALL SELECT path, 'Größe' || r_regionkey, 'öffne', 'Nation$X', 'erste', 1 FROM gr
  UNION ALL SELECT path, 'Größe' || r_regionkey, 'öffne', 'Größe' || r_regionkey, 'zweite', 2 FROM gr)"""
RELATIONS = [
    IMPLEMENTS,
    CALLS,
    "ext AS (SELECT name AS source, parent AS target, 'extends' AS relation FROM ty WHERE parent IS NOT NULL)",
    "imp AS (SELECT name AS source, interface AS target, 'implements' AS relation FROM im)",
    """aso AS (SELECT type_name AS source, field_type AS target, 'associates' AS relation FROM me
  WHERE member = 'field' AND (field_type LIKE 'Customer%' OR field_type LIKE 'Nation%'))""",
    "use AS (SELECT caller_type AS source, receiver AS target, 'uses' AS relation FROM ca WHERE receiver NOT IN ('owner', 'Nation$X'))",
    "rel AS MATERIALIZED (FROM ext UNION ALL FROM imp UNION ALL FROM aso UNION ALL FROM use)",
]
GRAPH = [
    """decl_nodes AS (SELECT path || '::' || name AS node_id, kind AS type, content, path, seq FROM (
  SELECT *, row_number() OVER (PARTITION BY path, name ORDER BY seq DESC) AS rn FROM de) WHERE rn = 1)""",
    """nodes AS MATERIALIZED (SELECT path AS node_id, 'file' AS type, content, path, -1 AS seq FROM corpus WHERE content <> ''
  UNION ALL SELECT node_id, type, content, path, seq FROM decl_nodes)""",
    "edges AS MATERIALIZED (SELECT path AS src, node_id AS dst FROM decl_nodes)",
]


def over_corpus(*ctes: str, body: str) -> str:
    return _with(*corpus(), *ctes, body=body)


def diagram_lines() -> list[str]:
    arrow = " ".join(
        f"WHEN '{r}' THEN '    ' || source || '{a}' || target || '{b}'" for r, (a, b) in EDGE_TEXT.items()
    )
    number = " ".join(f"WHEN '{r}' THEN {i}" for i, r in enumerate(EDGE_TEXT, 1))
    return [
        PACKAGE_ROWS, *RELATIONS,
        "home AS (SELECT DISTINCT path, coalesce(package, '') AS package FROM ty LEFT JOIN pk USING (path))",
        "groups AS (SELECT DISTINCT package FROM home)",
        f"""lines AS MATERIALIZED (
  SELECT package, 0 AS section, '' AS name, 0 AS part, 0 AS ordinal, '```mermaid' AS line FROM groups
  UNION ALL SELECT package, 0, '', 1, 0, 'classDiagram' FROM groups
  UNION ALL SELECT package, 1, name, 0, 0, '    class ' || name || ' {{' FROM ty JOIN home USING (path)
  UNION ALL SELECT package, 1, type_name, CASE member WHEN 'field' THEN 1 ELSE 2 END, ordinal,
    CASE member WHEN 'field' THEN '        ' || field_type || ' ' || name ELSE '        ' || name || '()' END
    FROM me JOIN home USING (path)
  UNION ALL SELECT package, 1, name, 3, 0, '    }}' FROM ty JOIN home USING (path)
  UNION ALL SELECT package, 2, source, 0, CASE relation {number} END, CASE relation {arrow} END
    FROM rel JOIN ty ON ty.name = rel.source JOIN home USING (path)
  UNION ALL SELECT package, 3, '', 0, 0, '```' FROM groups)""",
    ]


NODE_QUERIES = "SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'Nation' || n_nationkey || ' touch' AS text FROM nation"


def hashed(name: str, source: str, dim: int = 256) -> str:
    """``name(id, bucket, x)``: unit-length hashed word counts, non-zero cells."""
    return f"""{name} AS MATERIALIZED (
  SELECT id, bucket, n / sqrt(sum(n * n) OVER (PARTITION BY id)) AS x FROM (
    SELECT id, CAST(('0x' || substr(md5(term), 1, 8))::BIGINT % {dim} AS INTEGER) AS bucket, count(*) AS n FROM (
      SELECT id, unnest(regexp_extract_all(lower(text), {WORDS})) AS term FROM ({source})) GROUP BY ALL))"""


CODE_DIM = 64
CODE = [
    "ix AS MATERIALIZED (SELECT path || '::' || kind || '::' || name AS id, path, kind, name, content FROM de WHERE depth = 0)",
    hashed("hx", "SELECT id, content AS text FROM ix", CODE_DIM),
]
CODE_HITS = [
    *CODE,
    "qs AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, 'abstract class Nation' || n_nationkey || ' touch' AS text FROM nation)",
    hashed("hq", "SELECT query_id AS id, text FROM qs", CODE_DIM),
    """hits AS MATERIALIZED (SELECT query_id, CAST(rank AS INTEGER) AS rank, id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, id) AS rank FROM (
    SELECT q.id AS query_id, ix.id, round(2 - 2 * coalesce(d.dot, 0), 9) AS score
    FROM (SELECT DISTINCT id FROM hq) q CROSS JOIN ix
    LEFT JOIN (SELECT hq.id AS query_id, hx.id, sum(hq.x * hx.x) AS dot FROM hq JOIN hx USING (bucket) GROUP BY ALL) d
    ON d.query_id = q.id AND d.id = ix.id)) WHERE rank <= 5)""",
]
CODE_SHOWN = "SELECT query_id, rank, kind, content FROM hits JOIN ix USING (id)"


# ---- all -------------------------------------------------------------------------------

# ---- the shop files --------------------------------------------------------------------

# (type, method, receiver, callee, type of the receiver, how it was found); None: not resolved
SHOP_CALLS = [
    ("Color", "paint", "brush", "draw", "Brush", "parameter"), ("Color", "paint", "this.brush", "dry", "Brush", "field"),
    ("Pair", "sum", "left", "size", "Left", "parameter"), ("Pair", "sum", "right", "size", "Right", "parameter"),
    ("Part{p}", "Part{p}", "owner", "home", "Owner", "parameter"), ("Part{p}", "Part{p}", "this", "run", "Part{p}", "this"),
    ("Part{p}", "run", "home", "touch", "Guest", "parameter"), ("Part{p}", "run", "this.home", "touch", "Nation", "field"),
    ("Part{p}", "run", "item", "pack", "Item", "parameter"), ("Part{p}", "run", "home", "first", "Guest", "parameter"),
    ("Part{p}", "run", "c", "size", "Cursor", "parameter"), ("Part{p}", "run", "c", "next", "Cursor", "parameter"),
    ("Part{p}", "run", "c", "use", "Cursor", "parameter"), ("Part{p}", "run", "star", "shine", "Star", "parameter"),
    ("Part{p}", "run", "star", "late", "star", "name"),
    ("Part{p}", "walk", "home", "touch", "Nation", "field"), ("Part{p}", "walk", "tool", "use", "Guest", "local"),
    ("Part{p}", "walk", "this.tool", "use", "Tool{z}", "field"), ("Part{p}", "walk", "home", "light", "Lamp", "local"),
    ("Part{p}", "walk", "home", "again", "Nation", "field"), ("Part{p}", "walk", "list", "forEach", "list", "name"),
    ("Part{p}", "walk", "home", "turn", "Bolt", "parameter"), ("Part{p}", "walk", "own", "go", "Local{p}", "local"),
    ("Part{p}", "walk", "in", "read", "Stream", "parameter"), ("Part{p}", "walk", "oops", "print", "Oops", "parameter"),
    ("Part{p}", "walk", "Tool{z}", "touch", "Tool{z}", "name"), ("Part{p}", "walk", "a.b", "c", None, None),
    ("Part{p}", "walk", "x", "run", "x", "name"), ("Part{p}", "walk", "lens", "look", "Lens", "field"),
    ("Part{p}", "walk", "home", "touch", "Nation", "field"), ("Part{p}", "walk", "home", "one", "Nation", "field"),
    ("Part{p}", "walk", "home", "two", "Nation", "field"),
]
# (kind, name, type, depth, kind and name of the parent, text from the body's brace or the arrow on; None: no body)
SHOP_NODES = [
    ("field", "home", "Nation", 1, "class", "Part{p}", None), ("field", "far", "Map", 1, "class", "Part{p}", None),
    ("field", "tool", "Tool{z}", 1, "class", "Part{p}", None),
    ("enum", "Color", None, 1, "class", "Part{p}", "{ RED, BLUE; Brush brush; void paint(Brush brush) { brush.draw(); this.brush.dry(); } }"),
    ("field", "brush", "Brush", 2, "enum", "Color", None), ("method", "paint", None, 2, "enum", "Color", "{ brush.draw(); this.brush.dry(); }"),
    ("record", "Pair", None, 1, "class", "Part{p}", "{ int sum() { return left.size() + right.size(); } }"),
    ("method", "sum", None, 2, "record", "Pair", "{ return left.size() + right.size(); }"),
    ("class", "Local{p}", None, 1, "class", "Part{p}", "{ }"),
    ("constructor", "Part{p}", None, 1, "class", "Part{p}", "{ this.home = owner.home(); this.run(null); }"),
    ("method", "run", None, 1, "class", "Part{p}", C.PART.split("throws Oops ", 1)[1].split("\n  }", 1)[0] + "\n  }"),
    ("method", "walk", None, 1, "class", "Part{p}", C.PART.split("void walk() ", 1)[1].split("\n  }", 1)[0] + "\n  }"),
    ("lambda", None, None, 2, "method", "walk", "-> { Lamp home = null; home.light(); }"), ("lambda", None, None, 3, None, None, None),
    ("lambda", None, None, 2, "method", "walk", None), ("anonymous", "Thread", None, 2, "method", "walk", "{ Lens lens; void see() { lens.look(); home.touch(); } }"),
    ("field", "lens", "Lens", 3, "anonymous", "Thread", None), ("method", "see", None, 3, "anonymous", "Thread", "{ lens.look(); home.touch(); }"),
    ("class", "Part{p}", None, 0, None, None, "{" + C.PART.split("implements Visible {", 1)[1].rstrip("\n")),
]
SHOP_EDGES = [
    ("extends", "shop.z{z}.Base{z}", "package"), ("implements", "Visible", "global"), ("associates", "tools.b.Tool{z}", "import"),
    ("uses", "tools.b.Tool{z}", "import"), ("uses", "tools.b.Tool{z}", "import"), ("uses", "shop.z{z}.Part{p}.Local{p}", "file"),
]


def _filled(value: str | int | None, columns: dict[str, str]) -> str:
    if value is None:
        return "NULL"
    return str(value) if isinstance(value, int) else C.sql_concat(value, columns).replace("STRING", "VARCHAR")


def _part_rows(rows: list[tuple], names: list[str]) -> str:
    """The rows for every part."""
    def one(row: tuple) -> str:
        return "SELECT " + ", ".join(f"{_filled(v, C.PART_COLUMNS)} AS {n}" for v, n in zip(row, names)) + " FROM part"

    return "\nUNION ALL ".join(map(one, rows))


def shop(out: dict[str, str]) -> None:
    path, size = "src/shop/z{z}/Part{p}.java", {"z": "p_size"}
    sizes = "(SELECT DISTINCT p_size FROM part) s"
    fill = lambda t: _filled(t, size)
    out["resolved_calls"] = _part_rows([(path, *c) for c in SHOP_CALLS], ["path", "caller_type", "caller_method", "receiver", "callee", "receiver_type", "how"])
    columns = ["path", "kind", "name", "type", "depth", "parent_kind", "parent_name", "body"]
    few = [  # (path, kind, name, type, depth, parent kind, parent name, body)
        ("src/shop/z{z}/Base{z}.java", "class", "Base{z}", None, 0, None, None, "{ Tool{z} tool; }"),
        ("src/shop/z{z}/Base{z}.java", "field", "tool", "Tool{z}", 1, "class", "Base{z}", None),
        ("src/other/z{z}/Base{z}.java", "class", "Base{z}", None, 0, None, None, "{ }"),
        ("src/tools/a/Tool{z}.java", "class", "Tool{z}", None, 0, None, None, "{ }"),
        ("src/tools/b/Tool{z}.java", "class", "Tool{z}", None, 0, None, None, "{ void touch() { } }"),
        ("src/tools/b/Tool{z}.java", "method", "touch", None, 1, "class", "Tool{z}", "{ }"),
    ]
    nodes = [_part_rows([(path, *n) for n in SHOP_NODES], columns)]
    nodes += ["SELECT " + ", ".join(f"{_filled(v, size)} AS {n}" for v, n in zip(row, columns)) + f" FROM {sizes}" for row in few]
    nodes.append("SELECT 'src/Visible.java', 'interface', 'Visible', NULL, 0, NULL, NULL, '{ }'")
    out["syntax_nodes"] = f"""SELECT path, kind, name, type, CAST(depth AS INTEGER) AS depth, parent_kind, parent_name, CAST(length(body) AS INTEGER) AS size
FROM ({" UNION ALL ".join(nodes)})"""
    declared = [("shop.z{z}.Base{z}", "Base{z}", "src/shop/z{z}/Base{z}.java"), ("other.z{z}.Base{z}", "Base{z}", "src/other/z{z}/Base{z}.java"),
                ("tools.a.Tool{z}", "Tool{z}", "src/tools/a/Tool{z}.java"), ("tools.b.Tool{z}", "Tool{z}", "src/tools/b/Tool{z}.java")]
    part = [("Part{p}", "Part{p}", "class"), ("Part{p}.Color", "Color", "enum"), ("Part{p}.Pair", "Pair", "record"), ("Part{p}.Local{p}", "Local{p}", "class")]
    rows = [_part_rows([("shop.z{z}." + q, n, k, path, 1) for q, n, k in part], ["qualified", "name", "kind", "path", "files"])]
    rows += [f"SELECT {fill(q)}, {fill(n)}, 'class', {fill(p)}, 1 FROM {sizes}" for q, n, p in declared]
    out["qualified_types"] = "SELECT qualified, name, kind, path, CAST(files AS BIGINT) AS files FROM (" + " UNION ALL ".join([*rows, "SELECT 'Visible', 'Visible', 'interface', 'src/Visible.java', 1"]) + ")"
    edges = [_part_rows([("shop.z{z}.Part{p}", t, r, h) for r, t, h in SHOP_EDGES], ["source", "target", "relation", "how"])]
    edges += [f"SELECT {fill(s)}, {fill(t)}, '{r}', '{h}' FROM {sizes}" for s, t, r, h in [
        ("shop.z{z}.Base{z}", "tools.a.Tool{z}", "associates", "ambiguous"), ("other.z{z}.Base{z}", "Visible", "extends", "global"),
        ("tools.b.Tool{z}", "other.z{z}.Base{z}", "extends", "ambiguous")]]
    out["qualified_relations"] = " UNION ALL ".join(edges)


# ---- learned sentence borders ------------------------------------------------------------

def sentence_model() -> str:
    from codequarry.operators import sentences as S

    opening, closing = _quoted(S.OPENING), _quoted(S.CLOSING)
    part = lambda k, n, x: f"(CASE WHEN {k} > 0 THEN {k} * ln({x}) ELSE 0.0 END + CASE WHEN {n} - {k} > 0 THEN ({n} - {k}) * ln(1 - {x}) ELSE 0.0 END)"

    def ratio(a: str, b: str, ab: str, n: str) -> str:
        rate, with_a, without = f"({b} / {n})", f"({ab} / {a})", f"(({b} - {ab}) / ({n} - {a}))"
        rest, others = f"({b} - {ab})", f"({n} - {a})"
        return f"2 * ({part(ab, a, with_a)} + {part(rest, others, without)} - {part(ab, a, rate)} - {part(rest, others, rate)})"

    special = lambda w, flag: f"({flag} OR {w} = '#' OR regexp_matches({w}, '^\\p{{L}}$'))"
    return _with(
        "cut AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[ \\t\\n\\x0B\\f\\r]*[^ \\t\\n\\x0B\\f\\r]+') AS l FROM documents))",
        f"cored AS (SELECT *, rtrim(ltrim(trim(raw, {SPACES}), {opening}), {closing}) AS core FROM cut)",
        """tk AS MATERIALIZED (SELECT *, lag(word) OVER r AS before, lag(mark) OVER r AS before_mark, lead(word) OVER r AS next, lead(up) OVER r AS next_upper FROM (
  SELECT doc_id, pos, raw, CASE WHEN right(core, 1) IN ('.', '!', '?') THEN right(core, 1) ELSE '' END AS mark,
    CASE WHEN regexp_matches(core, '^[0-9][0-9.,]*$') THEN '#' ELSE lower(rtrim(core, '.!?')) END AS word,
    left(core, 1) = lower(left(core, 1)) AND left(core, 1) <> upper(left(core, 1)) AS low,
    left(core, 1) <> lower(left(core, 1)) AND left(core, 1) = upper(left(core, 1)) AS up FROM cored)
  WINDOW r AS (PARTITION BY doc_id ORDER BY pos))""",
        """wd AS MATERIALIZED (SELECT word, count(*)::DOUBLE AS n, count(*) FILTER (WHERE mark = '.')::DOUBLE AS stopped,
  count(*) FILTER (WHERE mark = '')::DOUBLE AS bare, count(*) FILTER (WHERE low) AS small FROM tk GROUP BY word)""",
        "tot AS MATERIALIZED (SELECT sum(n) AS total, sum(stopped) / sum(n) AS rate FROM wd)",
        f"""ab AS MATERIALIZED (SELECT word FROM (SELECT *, (length(word) - length(replace(word, '.', '')))::DOUBLE AS dots, length(replace(word, '.', ''))::DOUBLE AS letters FROM wd, tot)
  WHERE stopped > 0 AND regexp_matches(word, '\\p{{L}}')
  AND 2 * ({part('stopped', '(stopped + bare)', str(S.STOPPED))} - {part('stopped', '(stopped + bare)', 'rate')}) * exp(-letters) * (dots + 1) * pow(letters, -bare) >= {S.ABBREVIATION})""",
        f"""fi AS MATERIALIZED (SELECT *, coalesce(before_mark = '.' AND NOT {special('before', 'bs')}, false) AS ends FROM (
  SELECT tk.*, a.word IS NOT NULL AS short, b.word IS NOT NULL AS bs FROM tk LEFT JOIN ab a ON a.word = tk.word LEFT JOIN ab b ON b.word = tk.before))""",
        """sd AS MATERIALIZED (SELECT word, wd.n, small, starts, inside FROM (
  SELECT word, count(*) FILTER (WHERE ends)::DOUBLE AS starts, count(*) FILTER (WHERE up AND NOT (ends OR coalesce(before_mark IN ('!', '?'), true))) AS inside FROM fi GROUP BY word) JOIN wd USING (word))""",
        "br AS MATERIALIZED (SELECT sum(starts) AS breaks FROM sd)",
        f"""st AS MATERIALIZED (SELECT word FROM sd, tot, br WHERE starts > 0 AND breaks < total AND regexp_matches(word, '\\p{{L}}')
  AND starts * total > breaks * n AND {ratio('breaks', 'n', 'starts', 'total')} >= {S.STARTER})""",
        "onl AS MATERIALIZED (SELECT word FROM sd WHERE small > 0 AND inside = 0)",
        f"""pr AS MATERIALIZED (SELECT m.word, m.next FROM (
    SELECT word, next, count(*)::DOUBLE AS together FROM fi WHERE mark = '.' AND {special('word', 'short')} AND regexp_matches(next, '\\p{{L}}') GROUP BY ALL HAVING count(*) > 1) m
  JOIN (SELECT word, n AS a FROM wd) x USING (word) JOIN (SELECT word AS next, n AS b FROM wd) y USING (next), tot
  WHERE a < total AND together * total > a * b AND {ratio('a', 'b', 'least(together, a, b)', 'total')} >= {S.PAIR} AND m.next NOT IN (SELECT word FROM st))""",
        f"""ds AS (SELECT f.doc_id, f.pos, raw, mark <> '' AND NOT (mark = '.' AND f.next IS NOT NULL AND {special('f.word', 'short')}
    AND NOT coalesce(next_upper AND pr.word IS NULL AND (st.word IS NOT NULL OR onl.word IS NOT NULL), false)) AS cuts
  FROM fi f LEFT JOIN pr ON pr.word = f.word AND pr.next = f.next LEFT JOIN st ON st.word = f.next LEFT JOIN onl ON onl.word = f.next)""",
        "nu AS (SELECT *, coalesce(sum(CASE WHEN cuts THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent FROM ds)",
        body=f"SELECT doc_id, CAST(sent AS INTEGER) AS sent_id, trim(string_agg(raw, '' ORDER BY pos), {SPACES}) AS sentence FROM nu GROUP BY doc_id, sent",
    )


def statements() -> dict[str, str]:
    common = ", ".join(f"'{t}'" for t in COMMON_TYPES)
    doc_files = "SELECT 'docs/' || doc_id AS path, text AS content FROM documents"
    no_comment = C.sql_concat(
        "\npackage r{r}.n{n};\nimport model.Customer{k};\nimport java.util.List;\nimport static x.Y.z;\n\n",
        C.ORDER_COLUMNS,
    )
    doc_hits = text_search(BENCH_QUERIES, DOC_TEXTS)
    out = {}

    # scans, sources, sinks
    out["quarantine_bad_files"] = (
        "SELECT 'docs/' || doc_id AS path, CAST(octet_length(encode(text)) + 1 AS BIGINT) AS length FROM documents WHERE lang <> 'en'"
    )
    out["drop_empty_files"] = over_corpus(body="SELECT path, md5(content) AS content_md5 FROM corpus WHERE content <> ''")
    out["corpus_fingerprint"] = f"""SELECT count(*) AS n_files,
  CAST(sum(('0x' || substr(md5(path || '::' || md5(content)), 1, 12))::BIGINT) AS VARCHAR) AS digest FROM ({doc_files})"""
    out["load_or_create_index"] = over_corpus(
        *CODE,
        body="""SELECT path, kind, name, md5(content) AS content_md5, cells
FROM ix JOIN (SELECT id, count(*) AS cells FROM hx GROUP BY id) USING (id)""",
    )
    out["apply_changes"] = over_corpus(
        *CODE,
        body="""SELECT path, kind, name, md5(content) AS content_md5, cells,
  CASE WHEN path LIKE 'src/model/Nation%' THEN 4 WHEN path LIKE 'src/model/Customer%' OR path LIKE 'Größe%' THEN 1 ELSE 0 END AS since
FROM ix JOIN (SELECT id, count(*) AS cells FROM hx GROUP BY id) USING (id)""",
    )
    out["stream_index"] = over_corpus(
        *CODE,
        body="""SELECT path, kind, name, md5(content) AS content_md5, CASE WHEN path LIKE 'src/model/%' THEN 1 ELSE 0 END AS since FROM ix""",
    )
    shop(out)
    out["sentence_model"] = sentence_model()
    out["code_search"] = over_corpus(
        *CODE_HITS, body="SELECT query_id, rank, id, kind, round(score, 5) AS score, md5(content) AS content_md5 FROM hits JOIN ix USING (id)"
    )
    out["code_prompt"] = over_corpus(
        *CODE_HITS, *prompts("typed", CODE_SHOWN), *prompts("numbered", CODE_SHOWN),
        body="SELECT *, 'typed' AS style FROM prompts_typed UNION ALL SELECT *, 'numbered' FROM prompts_numbered",
    )
    out["scan_files"] = """SELECT 'd' || item_id % 3 || '/' || CASE item_id % 5 WHEN 1 THEN '_' WHEN 2 THEN '.' ELSE '' END || 'item' || item_id || '.txt' AS path,
  CAST(CASE item_id % 5 WHEN 3 THEN 0 WHEN 4 THEN octet_length(encode(text)) + 1 ELSE octet_length(encode(text)) END AS BIGINT) AS length,
  CASE item_id % 5 WHEN 3 THEN md5('') WHEN 4 THEN NULL ELSE md5(text) END AS content_md5, item_id % 5 <> 4 AS good FROM benchmark"""
    out["read_documents"] = "SELECT doc_id, text FROM documents"
    out["write_diagram"] = over_corpus(*diagram_lines(), body="SELECT package, line FROM lines")
    out["results_table"] = _with(
        *doc_hits,
        body="SELECT query_id, rank, 'docs/' || id AS path, lang AS kind, text AS content FROM hits JOIN documents ON doc_id = id",
    )

    # extraction
    out["strip_comments"] = over_corpus(
        body=f"SELECT path, {no_comment} || {C.order_class_sql()} || {NL} AS content FROM o "
        "UNION ALL SELECT path, content FROM corpus WHERE path LIKE 'src/model/%' OR path LIKE 'Größe%'"
    )
    out["extract_packages"] = over_corpus(PACKAGE_ROWS, body="SELECT path, package, class_name FROM pk")
    out["package_members"] = over_corpus(
        PACKAGE_ROWS, body="SELECT package, class_name, count(*) AS files FROM pk GROUP BY ALL"
    )
    out["extract_imports"] = over_corpus(
        body="SELECT path, 'Customer' || o_custkey AS simple_name, 'model.Customer' || o_custkey AS full_name FROM o"
    )
    out["extract_types"] = over_corpus(body="SELECT path, name, kind, parent, implements FROM ty")
    out["explode_implements"] = over_corpus(IMPLEMENTS, body="SELECT path, name, interface FROM im")
    out["extract_type_body"] = over_corpus(body="SELECT path, name, body FROM ty")
    out["extract_methods"] = over_corpus(
        body="SELECT path, type_name, ordinal, name FROM me WHERE member = 'method'"
    )
    out["extract_fields"] = over_corpus(
        body="SELECT path, type_name, ordinal, field_type, name FROM me WHERE member = 'field'"
    )
    out["extract_calls"] = over_corpus(
        CALLS, body="SELECT path, caller_type, caller_method, receiver, callee FROM ca"
    )
    out["top_level_snippets"] = over_corpus(body="SELECT path, kind, name, content FROM de WHERE depth = 0")
    out["nested_declarations"] = over_corpus(
        body="""SELECT path, kind, name, CAST(depth AS INTEGER) AS depth, content,
  CAST(row_number() OVER (PARTITION BY path ORDER BY seq) AS INTEGER) AS nth FROM de"""
    )
    out["declaration_name"] = over_corpus(body="SELECT path, kind, name, count(*) AS n FROM de GROUP BY ALL")
    out["slice_span"] = over_corpus(
        body="SELECT path, type_name, name, text AS content FROM me WHERE member = 'field'"
    )
    out["filter_common_types"] = over_corpus(
        body=f"SELECT path, type_name, field_type, name FROM me WHERE member = 'field' AND field_type NOT IN ({common})"
    )
    out["flatten_snippets"] = over_corpus(
        body="""SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY seq) - 1 AS INTEGER) AS nth, content AS snippet FROM de"""
    )

    # joins
    out["associates_edges"] = over_corpus(*RELATIONS, body="FROM aso")
    out["uses_edges"] = over_corpus(*RELATIONS, body="FROM use")
    out["fetch_hits"] = _with(
        *vector_search(L2, "score", 5),
        body="SELECT query_id, rank, id, label FROM hits JOIN embeddings ON vec_id = id",
    )
    out["node_neighbours"] = over_corpus(
        *GRAPH, body="SELECT src AS node_id, dst AS neighbour FROM edges UNION ALL SELECT dst, src FROM edges"
    )
    out["query_x_vectors"] = _with(
        LABEL_MEANS,
        body=f"""SELECT CAST(label AS BIGINT) AS query_id, count(*) AS n, round(min(d), 5) AS nearest, round(avg(d), 5) AS mean
FROM (SELECT m.label, {L2} AS d FROM means m, embeddings e) GROUP BY label""",
    )
    out["topic_x_sentence"] = _with(
        *weights(), *kmeans(3),
        body="""SELECT doc_id, CAST(c AS INTEGER) AS cluster, count(*) AS related, round(max(score), 5) AS best
FROM tscore GROUP BY ALL""",
    )

    # aggregations
    out["graph_counts"] = over_corpus(
        *GRAPH, body="SELECT (SELECT count(*) FROM nodes) AS nodes, (SELECT count(*) FROM edges) AS edges"
    )
    out["snippet_counts"] = over_corpus(
        body="SELECT kind, count(*) AS snippets, count(DISTINCT path) AS files FROM de GROUP BY kind"
    )
    out["calls_by_method"] = over_corpus(
        CALLS, body="""SELECT path, caller_type, caller_method, string_agg(receiver || '.' || callee, ',' ORDER BY nth) AS calls FROM ca GROUP BY ALL"""
    )
    out["members_by_type"] = over_corpus(
        body="""SELECT path, type_name,
  coalesce(string_agg(field_type || ' ' || name, ',' ORDER BY ordinal) FILTER (member = 'field'), '') AS fields,
  coalesce(string_agg(name, ',' ORDER BY ordinal) FILTER (member = 'method'), '') AS methods FROM me GROUP BY ALL"""
    )
    out["nodes_last_wins"] = over_corpus(*GRAPH, body="SELECT node_id, type, content FROM decl_nodes")
    out["edges_dedup"] = over_corpus(*GRAPH, body="SELECT src, dst FROM edges")
    out["mean_pool"] = """SELECT CAST(label AS BIGINT) AS id, CAST(dim - 1 AS INTEGER) AS dim, round(avg(x), 5) AS x FROM (
  SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS dim FROM embeddings) GROUP BY ALL"""
    out["tfidf"] = _with(*weights(), body="SELECT doc_id, sent_id, term, round(w, 5) AS w FROM w")
    out["kmeans_topics"] = _with(
        *weights(), *kmeans(3), body="SELECT doc_id, sent_id, CAST(c AS INTEGER) AS cluster FROM l5"
    )

    out["kmeans_corpus"] = _with(
        *corpus_kmeans(), body="SELECT doc_id, sent_id, CAST(c AS INTEGER) AS cluster FROM l5"
    )

    out["seeded_topics"] = _with(
        *seeded_kmeans(), body="SELECT doc_id, sent_id, CAST(c AS INTEGER) AS cluster, CAST(start AS INTEGER) AS start FROM l5 JOIN best USING (start)"
    )

    # top-k
    out["topk_l2"] = _with(
        *vector_search(L2, "score", 5), body="SELECT query_id, rank, id, round(score, 5) AS score FROM hits"
    )
    out["top1_cosine"] = _with(
        *vector_search(COSINE, "score DESC", 1), body="SELECT query_id, rank, id, round(score, 5) AS score FROM hits"
    )
    out["cluster_medoid"] = _with(
        *weights(), *kmeans(3), body="SELECT doc_id, CAST(c AS INTEGER) AS cluster, sent_id FROM medoid"
    )
    out["key_sentences"] = _with(
        *weights(), *kmeans(3),
        body="SELECT doc_id, CAST(c AS INTEGER) AS cluster, sent_id, round(score, 5) AS score FROM keys",
    )
    mixed = BENCH_QUERIES + " UNION ALL SELECT 1000000 + n_nationkey, n_name FROM nation"
    out["no_hit_rows"] = _with(
        *text_search(mixed, DOC_TEXTS),
        body="""SELECT q.query_id, rank, id, round(score, 5) AS score, coalesce(n, 0) AS hit_count FROM qs q
LEFT JOIN hits h ON h.query_id = q.query_id
LEFT JOIN (SELECT query_id, count(*) AS n FROM hits GROUP BY 1) c ON c.query_id = q.query_id""",
    )
    out["graph_context"] = over_corpus(
        *GRAPH,
        f"nq AS ({NODE_QUERIES})",
        hashed("hn", "SELECT node_id AS id, content AS text FROM nodes"),
        hashed("hq", "SELECT query_id AS id, text FROM nq"),
        """best AS (SELECT query_id, node_id FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, node_id) AS rn FROM (
    SELECT hq.id AS query_id, hn.id AS node_id, round(sum(hq.x * hn.x), 9) AS score FROM hq JOIN hn USING (bucket) GROUP BY ALL))
  WHERE rn = 1)""",
        """near AS (SELECT query_id, node_id, 0 AS hop FROM best
  UNION ALL SELECT query_id, dst, 1 FROM best JOIN edges ON src = node_id
  UNION ALL SELECT query_id, src, 1 FROM best JOIN edges ON dst = node_id)""",
        body="""SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY hop, path, seq, node_id) - 1 AS INTEGER) AS rank,
  node_id, type, content FROM near JOIN nodes USING (node_id)""",
    )
    out["topk_sparse_cosine"] = _with(
        *doc_hits, body="SELECT query_id, rank, id, round(score, 5) AS score FROM hits"
    )

    # sets
    out["all_relations"] = over_corpus(*RELATIONS, body="FROM rel")
    out["extends_edges"] = over_corpus(*RELATIONS, body="FROM ext")
    out["implements_edges"] = over_corpus(*RELATIONS, body="FROM imp")
    out["type_catalogue"] = over_corpus(body="SELECT name, kind, path FROM ty")
    out["code_graph"] = over_corpus(
        *GRAPH,
        body="""SELECT node_id, type, md5(content) AS content_md5, coalesce(n, 0) AS degree FROM nodes LEFT JOIN (
  SELECT node_id, count(*) AS n FROM (SELECT src AS node_id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1) USING (node_id)""",
    )

    # scalar functions
    out["clean_label"] = f"SELECT page_id, {_clean('html')} AS label FROM pages"
    out["split_sentences"] = _with(sents(), body="SELECT doc_id, sent_id, sentence FROM sents")
    out["tokenize"] = _with(sents(), toks(), body="SELECT doc_id, sent_id, term FROM toks")
    out["l2_distance"] = _with(
        LABEL_MEANS, body=f"SELECT e.vec_id, round({L2}, 5) AS d FROM embeddings e JOIN means m ON m.label = e.label"
    )
    out["cosine_similarity"] = _with(
        LABEL_MEANS, body=f"SELECT e.vec_id, round({COSINE}, 5) AS c FROM embeddings e JOIN means m ON m.label = e.label"
    )
    out["node_key"] = over_corpus(body="SELECT path || '::' || name AS node_id, kind FROM ty")
    out["content_digest"] = f"SELECT path, md5(content) AS content_md5 FROM ({doc_files})"
    out["truncate_tokens"] = """SELECT doc_id, CAST(i AS INTEGER) AS part, array_to_string(list_slice(words, i * 512 + 1, i * 512 + 512), ' ') AS text
FROM (SELECT doc_id, regexp_extract_all(text, '[^ \\t\\n\\v\\f\\r]+') AS words FROM documents) d,
  LATERAL (SELECT unnest(range(0, greatest(1, CAST(ceil(len(words) / 512) AS BIGINT)))) AS i)"""

    # text products
    out["class_diagram"] = over_corpus(*diagram_lines(), body="FROM lines")
    out["prompt_typed"] = prompt("typed")
    out["prompt_numbered"] = prompt("numbered")
    out["graph_summary"] = _with(*weights(), *graph_rank(), body="SELECT doc_id, summary FROM gsumm")
    out["extractive_summary"] = _with(*weights(), *summary(), body="SELECT doc_id, summary FROM summ")
    out["extract_key_points"] = _with(
        *weights(), *kmeans(5), POINTS, body="SELECT doc_id, CAST(nth AS INTEGER) AS nth, point FROM pts"
    )
    out["topics_and_key_sentences"] = _with(
        *weights(), *kmeans(3), *summary(), POINTS, TOPICS,
        body="""SELECT doc_id, CAST(nth AS INTEGER) AS nth, topic, key_sentence, summary FROM topics JOIN summ USING (doc_id)""",
    )
    out["mindmap"] = _with(
        *weights(), *kmeans(3), *summary(), POINTS, TOPICS,
        f"""t AS (SELECT doc_id, string_agg('    Topic ' || nth || '[' || {_clean('topic')} || ']' || {NL} ||
  '      Key Point[' || {_clean('key_sentence')} || ']' || {NL}, '' ORDER BY nth) AS body FROM topics GROUP BY doc_id)""",
        body=f"""SELECT doc_id, '```mermaid' || {NL} || 'mindmap' || {NL} || '  root((Document))' || {NL} ||
  '    Summary[' || {_clean('summary')} || ']' || {NL} || coalesce(body, '') || '```' AS diagram
FROM summ LEFT JOIN t USING (doc_id)""",
    )
    out["flowchart"] = _with(
        *weights(), *kmeans(5), *summary(), POINTS,
        f"""t AS (SELECT doc_id, string_agg('    A --> B' || nth || '[' || {_clean('point')} || ']' || {NL}, '' ORDER BY nth) AS body
  FROM pts GROUP BY doc_id)""",
        body=f"""SELECT doc_id, '```mermaid' || {NL} || 'flowchart TD' || {NL} || '    A[' || {_clean('summary')} || ']' || {NL} ||
  coalesce(body, '') || '```' AS diagram FROM summ LEFT JOIN t USING (doc_id)""",
    )
    out["sequence_diagram"] = _with(
        *weights(), *kmeans(4), POINTS,
        f"""t AS (SELECT doc_id, string_agg(CASE WHEN nth % 2 = 1 THEN '    Human->>AI: Step ' || nth
  ELSE '    AI->>Human: ' || {_clean('point')} END || {NL}, '' ORDER BY nth) AS body FROM pts GROUP BY doc_id)""",
        body=f"""SELECT doc_id, '```mermaid' || {NL} || 'sequenceDiagram' || {NL} || '    participant Human' || {NL} ||
  '    participant AI' || {NL} || body || '```' AS diagram FROM t""",
    )

    # streaming, incremental, user functions
    out["stream_search"] = _with(
        *text_search("SELECT conv_id * 1000000 + turn AS query_id, text FROM conversations", DOC_TEXTS), *prompts("numbered"),
        body="SELECT query_id, rank, id, round(score, 5) AS score, md5(prompt) AS prompt_md5 FROM hits JOIN prompts_numbered USING (query_id)",
    )
    out["incremental_index"] = """SELECT 'docs/' || d.doc_id AS path, CASE WHEN l.doc_id IS NULL THEN 'added' ELSE 'changed' END AS change
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE l.doc_id IS NULL OR l.toxic = 1
UNION ALL SELECT 'pages/' || page_id, 'removed' FROM pages"""
    doc_path = "concat_ws('/', 'docs', source, lang, CAST(doc_id AS VARCHAR))"
    now = f"now AS (SELECT {doc_path} AS path, md5(text) AS content_md5 FROM documents)"
    before = f"""before AS (SELECT {doc_path} AS path, md5(CASE WHEN toxic = 1 THEN text || ' ' ELSE text END) AS content_md5
FROM documents JOIN labels USING (doc_id) UNION ALL SELECT 'pages/' || page_id, md5(html) FROM pages)"""
    out["folder_digests"] = _with(now, folder_tree("now"), body="SELECT level, path, n_files, digest FROM now_tree WHERE NOT is_file")
    out["changed_folders"] = _with(now, before, folder_tree("now"), folder_tree("before"), body="""SELECT level, path, is_file,
  CASE WHEN b.digest IS NULL THEN 'added' WHEN n.digest IS NULL THEN 'removed' ELSE 'changed' END AS change
FROM before_tree b FULL JOIN now_tree n USING (level, path, is_file)
WHERE (b.n_files, b.digest) IS DISTINCT FROM (n.n_files, n.digest)""")
    out["hash_embed"] = _with(
        hashed("h", "SELECT doc_id AS id, text FROM documents"),
        body="SELECT id, bucket AS dim, round(x, 5) AS x FROM h",
    )
    out["embed_long"] = _with(
        f"win AS MATERIALIZED (SELECT {{'doc': doc_id, 'part': part}} AS id, text FROM ({out['truncate_tokens']}))",
        hashed("h", "FROM win"),
        body="""SELECT id.doc AS id, bucket AS dim, round(sum(x) / any_value(n), 5) AS x
FROM h JOIN (SELECT id.doc AS doc, count(*) AS n FROM win GROUP BY ALL) ON doc = id.doc GROUP BY ALL""",
    )
    out["batch_generate"] = _with(
        *doc_hits, *prompts("numbered"),
        body="SELECT query_id, 'Seen: ' || md5(prompt) AS response, CAST(NULL AS VARCHAR) AS error FROM prompts_numbered",
    )
    out["answer_store"] = """SELECT doc_id AS query_id, 'Seen: ' || md5(concat('Summarise:', chr(10), text)) AS response, CAST(NULL AS VARCHAR) AS error,
  md5(text) IN (SELECT md5(text) FROM documents SEMI JOIN labels USING (doc_id)) AS reused FROM documents"""
    return out
