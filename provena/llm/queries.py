"""The queries opN_<name>: each applies its operator to the whole intended table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from provena.llm import conversation_repair, decontaminate, licenses, mixing, packing, pii, pst, rabitq, simhash_bktree, string_kernel, url_filter, vector_codes, warc
from provena.session import table


TOKENIZER = "word_bpe_49k.json"


def op5_rabitq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every fiftieth one."""
    indexed = rabitq.index(table(spark, sf_dir, "embeddings"))
    found = rabitq.search(indexed, indexed.where(F.col("id") % 50 == 0))
    return found.select("query_id", "rank", F.col("id").alias("vec_id"), "score")


OP5_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
  AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT vec_id, list_transform(e, lambda x: x * pow(2.0, -greatest(floor(log2(list_max(list_transform(e, lambda y: abs(y))))), -1022))) AS e FROM v),
n AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS l FROM p),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) / (q.l * c.l) AS score
  FROM n q JOIN n c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5
"""


#: A fixed key makes the query repeatable; a production run passes its own secret.
DEMO_KEY = b"pseudonyms of the public test tables"


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document; base places are those of licenses.BASE."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", licenses.scans(F.col("text")).alias("s"))
    base = F.filter("s.places", lambda p: p["kind"] == "base")
    found = found.select("doc_id", "s", base.alias("base"))
    label = F.array_sort(F.array_distinct(F.transform("base", lambda p: p["label"])))
    return found.select(
        "doc_id", F.col("s.n_words").alias("n_words"), F.size("base").cast("long").alias("n_base"),
        F.array_min(F.transform("base", lambda p: p["word"])).alias("first_word"), F.array_max(F.transform("base", lambda p: p["word"])).alias("last_word"),
        F.array_join(label, ",").alias("base_labels"), F.array_join("s.labels", ",").alias("labels"), F.col("s.score").alias("score"),
        F.array_join(F.transform("s.expressions", lambda e: e["postfix"]), ";").alias("expressions"),
    )


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item inside every document: doc_id, item_id, shingles shared and in the item."""
    return decontaminate.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP2_SQL = r"""
WITH docs AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(string_split_regex(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
dg AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM docs WHERE len(w) >= 5),
ig AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM items WHERE len(w) >= 5),
q AS (SELECT item_id, count(*) AS n_item FROM ig GROUP BY item_id),
hit AS (SELECT doc_id, item_id, count(*) AS n_shared FROM dg JOIN ig USING (g) GROUP BY doc_id, item_id)
SELECT doc_id, item_id, n_shared, n_item FROM hit JOIN q USING (item_id) WHERE n_shared >= 0.8 * n_item - 1e-9
"""


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages and reads the archives back."""
    manifest = warc.write_archives(table(spark, sf_dir, "pages"), warc.archive_folder(spark))
    read = warc.read_archives(manifest)
    page = F.expr("try_cast(record_id AS BIGINT)")
    return read.select(page.alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.expr("try_cast(refers_to AS BIGINT)").alias("refers_to"))


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
b AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, x,
  list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, CAST(5 * i + 1 AS BIGINT), 5))::BIGINT // (CAST(32 AS BIGINT) ** (3 - j))::BIGINT) % 32)::BIGINT + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
  max(page_id) OVER (PARTITION BY x) AS keep FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to FROM b
"""


def op4_string_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document; the model sees the rows that are not held out."""
    docs = table(spark, sf_dir, "documents")
    fold = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 3
    model = string_kernel.train(docs.where(fold != 1))
    found = docs.select("doc_id", (fold == 1).alias("held_out"), string_kernel.predict(docs, model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))


def op7_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text with pseudonyms for its personal data, the kinds and number of the values."""
    docs = table(spark, sf_dir, "documents")
    found = docs.select("doc_id", pii.pseudonyms(F.col("text"), DEMO_KEY).alias("p"))
    return found.select("doc_id", F.col("p.text").alias("text"), F.col("p.kinds").alias("kinds"), F.col("p.n").cast("long").alias("n_values"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each piece of a document in a packed sequence."""
    import public_tokenizers

    pieces = packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")


def op8_simhash_bktree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id of every document."""
    found = simhash_bktree.simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's URL."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


OP9_SQL = """
WITH p AS (SELECT page_id, coalesce(lower(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1)), '') AS host,
  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(rh, rp, rv) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
j AS (SELECT page_id, host, path, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC NULLS LAST, length(rh) DESC, rv DESC) AS k
  FROM p LEFT JOIN r ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM j WHERE k = 1
"""


def op10_pst(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram base and suffix-tree score of every document."""
    docs = table(spark, sf_dir, "documents")
    model = pst.train(docs.where(~pst.held_out(F.col("doc_id"))))
    scores = pst.score(docs, model)
    return scores.select("doc_id", pst.held_out(F.col("doc_id")).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, error and label's error of every vector, and the digest of the codebooks."""
    coded, books = vector_codes.compress(table(spark, sf_dir, "embeddings"))
    code = F.array_join(F.transform("code", lambda c: F.lpad(F.lower(F.hex(c)), 2, "0")), "")
    return coded.select("vec_id", code.alias("code"), "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))


def _op12_sql() -> str:
    rounds = []
    for k in range(7):
        rounds.append(f"""a{k} AS MATERIALIZED (SELECT n, p, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT n, x.p, c.e, list_sum(list_transform(list_zip(x.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d
  FROM x JOIN c{k} c ON c.p = x.p) GROUP BY 1, 2)""")
        if k < 6:
            rounds.append(f"""m{k} AS (SELECT p, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (SELECT p, e, i, sum(y) AS s, count(*) AS n
  FROM (SELECT x.p, a.e, unnest(x.x) AS y, unnest(range(0, len(x.x))) AS i FROM x JOIN a{k} a ON a.n = x.n AND a.p = x.p) GROUP BY 1, 2, 3) GROUP BY 1, 2),
c{k + 1} AS MATERIALIZED (SELECT c.p, c.e, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m ON m.p = c.p AND m.e = c.e)""")
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS n, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * x::DOUBLE) AS BIGINT)) AS q FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
x AS MATERIALIZED (SELECT n, p, q[p * (len(q) // 8) + 1:(p + 1) * (len(q) // 8)] AS x FROM v, range(0, 8) t(p)),
c0 AS MATERIALIZED (SELECT p, n AS e, x FROM x WHERE n < 16),
{", ".join(rounds)},
coded AS (SELECT v.vec_id, v.label, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM v JOIN a6 ON a6.n = v.n GROUP BY v.n, v.vec_id, v.label),
digest AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c6)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256 FROM coded, digest
"""


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, its source's words and target, and the words of it that the mix takes."""
    return mixing.taken(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP13_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS u, doc_id, source, len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS size, md5(coalesce(doc_id::VARCHAR, '')) AS key FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS sid FROM d GROUP BY source),
w AS (SELECT *, (ARRAY[5, 2, 1])[sid % 3 + 1] AS weight, 2 * source_size AS top FROM s),
l AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS total, sum(weight) OVER () AS weights, coalesce(sum(top) OVER o, 0) AS before_top, coalesce(sum(weight) OVER o, 0) AS before_weight
  FROM w WINDOW o AS (ORDER BY top / weight, sid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
b AS (SELECT arg_max(total - before_top, (total - before_top) / (weights - before_weight)) AS rest, arg_max(weights - before_weight, (total - before_top) / (weights - before_weight)) AS among FROM l),
t AS (SELECT l.source, sid, source_size, CASE WHEN total = 0 THEN 0 ELSE least(top::DOUBLE, rest * weight / among) END AS target, source_size // 1024 AS whole FROM l, b),
e AS (SELECT sid, whole, 0 AS round, least(round(target)::BIGINT, source_size) AS words FROM t UNION ALL SELECT sid, whole, 1, greatest(round(target)::BIGINT - source_size, 0) FROM t),
r AS (SELECT sid, words, round, whole, unnest(range(0, (words + 1023) // 1024)) AS place, CASE round
  WHEN 0 THEN CASE WHEN whole % 1000003 <> 0 THEN 1000003 WHEN whole % 1000033 <> 0 THEN 1000033 ELSE 1000037 END
  ELSE CASE WHEN whole % 1000039 <> 0 THEN 1000039 WHEN whole % 1000081 <> 0 THEN 1000081 ELSE 1000099 END END AS stride FROM e WHERE words > 0),
k AS (SELECT sid, CASE WHEN place < whole THEN place * stride % whole ELSE whole END AS block, least(1024, words - place * 1024) AS words FROM r),
p AS (SELECT u, doc_id, size, sid, t.source_size, target, sum(size) OVER (PARTITION BY sid ORDER BY key, size, u) - size AS pos FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source),
c AS (SELECT u, sid, pos, size, unnest(range((pos // 1024)::BIGINT, ((pos + size - 1) // 1024)::BIGINT + 1)) AS block FROM p WHERE size > 0),
m AS (SELECT u, sum(greatest(least(pos + size - block * 1024, words) - greatest(pos - block * 1024, 0), 0)) AS taken FROM c JOIN k USING (sid, block) GROUP BY u)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM p LEFT JOIN m USING (u)
"""


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults of every damaged conversation, its cheapest repair and the digest of what results."""
    convs, turns = conversation_repair.repair(conversation_repair.damaged(table(spark, sf_dir, "conversations")), "copies")
    told = convs.join(conversation_repair.digests(turns), ["part", "seq"])
    return told.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.col("sha256").alias("repaired_sha256"))


def _op11_sql() -> str:
    least = lambda *ways: f"list_min(list_filter([{', '.join(ways)}], lambda w: w.c IS NOT NULL))"
    way = lambda state, cost, letter: f"{{'c': {state}.c + {cost}, 'a': {state}.a || '{letter}'}}"
    kept = lambda state, role: f"{{'c': CASE WHEN i = '{role}' AND NOT gone THEN {state}.c + stay END, 'a': {state}.a || 'K'}}"
    moved = lambda state: f"{{'c': CASE WHEN NOT gone THEN {state}.c + stay + 1 END, 'a': {state}.a || 'R'}}"
    none = "{'c': NULL::BIGINT, 'a': ''}"
    # the states before a turn's insertions are n, s, u, a; after them n, s, v, b
    return rf"""
WITH RECURSIVE tab AS (SELECT list(x ORDER BY b) AS t FROM (SELECT b, list_reduce(range(0, 8), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(3988292384, x // 2) ELSE x // 2 END, b) AS x FROM range(0, 256) g(b))),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')) AS z FROM conversations),
h AS (SELECT row_number() OVER () AS u, conv_id, turn, role, text, xor(4294967295, list_reduce(list_transform(range(1, octet_length(z) + 1), lambda p: ('0x' || substr(hex(z), CAST(2 * p - 1 AS BIGINT), 2))::BIGINT),
  lambda x, y: xor(x // 256, t[xor(x % 256, y) + 1]), 4294967295::BIGINT)) % 20 AS f FROM k, tab),
g AS (SELECT u, conv_id, turn, CASE f WHEN 4 THEN 'user' ELSE role END AS role, CASE f WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(0, CASE f WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
o AS MATERIALIZED (SELECT conv_id, turn, role, text, substr(role, 1, 1) AS i, row_number() OVER w AS nr, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, u, copy) > 1 AS again,
  NOT regexp_matches(text, '[^ 	-
]') AS blank, NOT regexp_matches(text, '[.!?][ 	-
]*$') AS cut FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), u, copy)),
p AS MATERIALIZED (SELECT *, blank OR again AS gone, CASE WHEN cut THEN 5 ELSE 0 END AS stay, lag(i) OVER (PARTITION BY conv_id ORDER BY nr) || i AS pair FROM o),
ids AS (SELECT conv_id, count(*) OVER () AS n_ids FROM conversations GROUP BY conv_id),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
  count(*) FILTER (cut AND NOT again AND NOT blank) AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM p GROUP BY conv_id),
way(conv_id, nr, n, s, v, b) AS (
  SELECT conv_id, 0::BIGINT, {{'c': 0::BIGINT, 'a': ''}}, {none}, {{'c': 5::BIGINT, 'a': 'I'}}, {{'c': 10::BIGINT, 'a': 'II'}} FROM ids
  UNION ALL
  SELECT conv_id, nr, n, s, {least("u", way("n", 5, "I"), way("s", 5, "I"), way("a", 5, "I"))}, {least("a", way("u", 5, "I"), way("n", 10, "II"), way("s", 10, "II"))} FROM (
    SELECT way.conv_id, p.nr, {way("way.n", 2, "D")} AS n, {least(kept("way.n", "s"), way("way.s", 2, "D"))} AS s,
      {least(kept("way.n", "u"), kept("way.s", "u"), kept("way.b", "u"), moved("way.n"), moved("way.s"), moved("way.b"), way("way.v", 2, "D"))} AS u,
      {least(kept("way.v", "a"), moved("way.v"), way("way.b", 2, "D"))} AS a
    FROM way JOIN p ON p.conv_id IS NOT DISTINCT FROM way.conv_id AND p.nr = way.nr + 1)),
best AS MATERIALIZED (SELECT way.conv_id, {least("way.n", "way.b")} AS w FROM way LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM way.conv_id WHERE way.nr = coalesce(c.n, 0)),
letters AS (SELECT conv_id, nr AS pos, substr(w.a, CAST(nr AS BIGINT), 1) AS letter FROM (SELECT conv_id, w, unnest(range(1, length(w.a) + 1)) AS nr FROM best)),
made AS (SELECT conv_id, pos, letter, sum(CASE WHEN letter <> 'I' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY pos) AS nr FROM letters),
rows_ AS (SELECT m.conv_id, pos, letter, p.role, p.text, p.i, row_number() OVER (PARTITION BY m.conv_id ORDER BY pos) AS place FROM made m LEFT JOIN p ON p.conv_id IS NOT DISTINCT FROM m.conv_id AND p.nr = m.nr AND m.letter <> 'I' WHERE letter <> 'D'),
lines AS (SELECT *, place - max(CASE WHEN place = 1 AND letter = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS nth FROM rows_),
texts AS (SELECT conv_id, string_agg(CASE letter WHEN 'K' THEN role ELSE CASE WHEN nth % 2 = 1 THEN 'user' ELSE 'assistant' END END || ':' || CASE letter WHEN 'I' THEN '' ELSE text END, chr(10) ORDER BY place) AS t FROM lines GROUP BY conv_id)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, w.c AS cost, w.a AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM ids JOIN best ON best.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN counts ON counts.conv_id IS NOT DISTINCT FROM ids.conv_id LEFT JOIN texts ON texts.conv_id IS NOT DISTINCT FROM ids.conv_id
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_licenses": op1_licenses,
        "op2_decontaminate": op2_decontaminate,
        "op3_warc": op3_warc,
        "op4_string_kernel": op4_string_kernel,
        "op5_rabitq": op5_rabitq,
        "op6_packing": op6_packing,
        "op7_pseudonyms": op7_pseudonyms,
        "op8_simhash_bktree": op8_simhash_bktree,
        "op9_url_filter": op9_url_filter,
        "op10_pst": op10_pst,
        "op11_conversation_repair": op11_conversation_repair,
        "op12_vector_codes": op12_vector_codes,
        "op13_mixing": op13_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_decontaminate": OP2_SQL,
        "op3_warc": OP3_SQL,
        "op5_rabitq": OP5_SQL,
        "op9_url_filter": OP9_SQL,
        "op11_conversation_repair": _op11_sql(),
        "op12_vector_codes": _op12_sql(),
        "op13_mixing": OP13_SQL,
    }
