"""Registered queries of the operators in this subpackage and their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES = {}
SQL: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op8_quality_trees(spark, sf_dir):
    from fillsight.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op1_simhash_bktree(spark, sf_dir):
    from fillsight.llm import simhash

    return simhash.classes(table(spark, sf_dir, "documents"))


@query
def op3_suffix_lpf(spark, sf_dir):
    from fillsight.llm import suffix

    return suffix.remove_repeats(table(spark, sf_dir, "documents"))


@query
def op9_positional_index(spark, sf_dir):
    from fillsight.llm import decontam

    return decontam.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


SQL["op9_positional_index"] = r"""
WITH dw AS (
  SELECT row_number() OVER () AS k, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
bw AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
bx AS (
  SELECT item_id, unnest(list_transform(generate_series(1, greatest(len(w) - 9, 1)), lambda s: w[s : s + 9])) AS g
  FROM bw WHERE len(w) > 0),
sizes AS (SELECT DISTINCT len(g) AS n FROM bx),
dx AS (
  SELECT k, n, unnest(generate_series(1, len(w) - n + 1)) AS s, w FROM dw, sizes WHERE len(w) >= n),
hit AS (SELECT k, s, n, item_id FROM dx JOIN bx ON dx.w[s : s + n - 1] = bx.g),
cover AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY k),
item AS (
  SELECT k, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids
  FROM hit GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN cover USING (k) LEFT JOIN item USING (k)
"""


def rank_file() -> bytes:
    import public_tokenizers

    from fillsight.llm.bpe import PATTERN, load_ranks

    if public_tokenizers.PATTERN != PATTERN:
        raise ValueError("the tokenizer's pattern is not the one the pieces are cut by")
    return load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))


@query
def op5_bpe_prefix_table(spark, sf_dir):
    from fillsight.llm import bpe

    return bpe.digests(table(spark, sf_dir, "documents"), rank_file())


@query
def op2_rank_order_language(spark, sf_dir):
    from fillsight.llm import langid

    return langid.identify(table(spark, sf_dir, "documents"))


@query
def op6_toxicity_bigru(spark, sf_dir):
    from fillsight.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op4_warc_chunk_table(spark, sf_dir):
    from fillsight.llm import warc

    return warc.round_trip(table(spark, sf_dir, "pages"))


SQL["op4_warc_chunk_table"] = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS h FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY h, n) AS last FROM p)
SELECT page_id, n::BIGINT AS payload_bytes,
       list_aggregate(list_transform(generate_series(0, 31), lambda i:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + ((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id < last THEN last END AS refers_to
FROM q
"""


@query
def op10_norm_sorted_topk(spark, sf_dir):
    from fillsight.llm import topk

    return topk.search_embeddings(table(spark, sf_dir, "embeddings"))


SQL["op10_norm_sorted_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
"""


@query
def op7_extendible_hash_shards(spark, sf_dir):
    from fillsight.llm import sharding

    return sharding.shard(table(spark, sf_dir, "documents"))


SQL["op7_extendible_hash_shards"] = """
WITH h AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n,
         md5(concat_ws('|', coalesce(doc_id::VARCHAR, ''), md5(coalesce(text, '')))) AS m FROM documents),
b AS (
  SELECT doc_id, n, list_aggregate(list_transform(generate_series(0, 31), lambda i:
           right('0000' || bin(('0x' || substr(m, i + 1, 1))::INT), 4)), 'string_agg', '') AS bits FROM h),
d AS (SELECT doc_id, n, bits, unnest(generate_series(0, 40)) AS depth FROM b),
s AS (SELECT depth, left(bits, depth) AS shard, sum(n) AS bytes FROM d GROUP BY 1, 2 HAVING sum(n) <= 1000000),
c AS (
  SELECT d.doc_id, d.n, d.bits, min(d.depth) AS depth FROM d JOIN s ON s.depth = d.depth AND s.shard = left(d.bits, d.depth)
  GROUP BY 1, 2, 3)
SELECT c.doc_id, c.n::BIGINT AS n_bytes, s.shard, c.depth::INT AS depth, s.bytes::BIGINT AS shard_bytes, false AS overflow
FROM c JOIN s ON s.depth = c.depth AND s.shard = left(c.bits, c.depth)
"""


@query
def op11_survivor_viterbi(spark, sf_dir):
    from fillsight.llm import conversation

    return conversation.repair(conversation.damaged(table(spark, sf_dir, "conversations")))


def _repair_sql() -> str:
    """One recursion over the rows of all conversations; each state is (cost, audit, repaired lines)."""
    none = "{'c': 1000000000::BIGINT, 'a': '', 'r': NULL::VARCHAR}"
    name = {2: "user", 3: "assistant"}
    follows = {0: 2, 1: 2, 2: 3, 3: 2}

    def step(x, cost, edit, line):
        add = "" if line is None else f" || {line}"
        text = f"{x}.r" if line is None else f"coalesce({x}.r || chr(10), ''){add}"
        return f"{{'c': {x}.c + {cost}, 'a': {x}.a || '{edit}', 'r': {text}}}"

    def least(ways):
        # cost first, then the ASCII-least edits; the edits decide the lines
        return f"list_sort([{', '.join(ways)}])[1]"

    def inserts(prefix, at):
        ways = [f"{prefix}{at}"]
        for source in range(4):
            x, here, hops = f"{prefix}{source}", source, 0
            while hops < 2:
                here, hops = follows[here], hops + 1
                x = step(x, 5, "I", f"'{name[here]}:'")
                if here == at:
                    ways.append(x)
        return least(ways)

    def over_row(at):
        ways = [step(f"i{at}", 2, "D", None)]
        for source in range(4):
            initials = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[source]
            for letter, to in initials.items():
                if to == at:
                    kept = step(f"i{source}", "x.extra", "K", "x.role || ':' || x.text")
                    ways.append(f"CASE WHEN NOT x.must AND left(x.role, 1) = '{letter}' THEN {kept} ELSE {none} END")
            if follows[source] == at:
                ways.append(f"CASE WHEN NOT x.must THEN {step(f'i{source}', '1 + x.extra', 'R', f"'{name[at]}:' || x.text")} ELSE {none} END")
        return least(ways)

    closed = ", ".join(f"{inserts('s', at)} AS i{at}" for at in range(4))
    walked = ", ".join(f"{over_row(at)} AS s{at}" for at in range(4))
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY n) AS t FROM (
    SELECT n, list_reduce(list_concat([n], range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
    FROM (SELECT unnest(range(256)) AS n))),
src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
kind AS (
  SELECT conv_id, turn, role, text, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(string_split(key, ''), lambda b: ascii(b)::BIGINT)),
           lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8))) % 20 AS k FROM src, crc),
damaged AS (
  SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN k = 1 THEN '' WHEN k = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(generate_series(1, CASE WHEN k = 3 THEN 2 ELSE 1 END)) AS copy FROM kind WHERE k <> 0),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy) AS n FROM damaged),
faulty AS (
  SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank'
                 WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY n) > 1 THEN 'duplicate'
                 WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\\z') THEN 'truncated' ELSE '' END AS fault,
         lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY n) || left(role, 1) AS pair
  FROM numbered),
x AS (
  SELECT conv_id, n, role, text, fault IN ('blank', 'duplicate') AS must, CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END AS extra FROM faulty),
walk AS (
  SELECT conv_id, 0::BIGINT AS n, {{'c': 0::BIGINT, 'a': '', 'r': NULL::VARCHAR}} AS s0, {none} AS s1, {none} AS s2, {none} AS s3
  FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, n, {walked} FROM (
    SELECT x.conv_id, x.n, x, {closed} FROM walk JOIN x ON x.conv_id IS NOT DISTINCT FROM walk.conv_id AND x.n = walk.n + 1)),
stats AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
         count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
         count(*) FILTER (pair IS NOT NULL AND pair NOT IN ('su', 'ua', 'au')) AS illegal, max(n) AS n
  FROM faulty GROUP BY conv_id),
ended AS (
  SELECT walk.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
         coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
         {least(["s0", "s3", step("s2", 5, "I", "'assistant:'"), step(step("s1", 5, "I", "'user:'"), 5, "I", "'assistant:'")])} AS best
  FROM walk LEFT JOIN stats ON stats.conv_id IS NOT DISTINCT FROM walk.conv_id WHERE walk.n = coalesce(stats.n, 0))
SELECT conv_id, gaps, blank, duplicate, truncated, illegal, best.c AS cost, best.a AS audit, sha256(coalesce(best.r, '')) AS repaired_sha256
FROM ended
"""


SQL["op11_survivor_viterbi"] = _repair_sql()


@query
def op12_line_blocks(spark, sf_dir):
    from fillsight.llm import pages

    return pages.extract(table(spark, sf_dir, "pages"))


# The pages of these tables mark their article and nest nothing else in it.
SQL["op12_line_blocks"] = r"""
WITH a AS (
  SELECT page_id, url, regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*)</article>', 1), '</?b>', '', 'g') AS h FROM pages),
t AS (SELECT page_id, url, regexp_replace(h, '<[^>]*>', ' ', 'g') AS h FROM a),
d AS (
  SELECT page_id, url, replace(regexp_replace(replace(replace(replace(h, '&quot;', '"'), '&lt;', '<'), '&gt;', '>'), '&amp;?', chr(1), 'g'), chr(1), '&') AS h FROM t),
w AS (SELECT page_id, url, trim(regexp_replace(h, '\s+', ' ', 'g')) AS text FROM d)
SELECT page_id, url, text, length(text)::BIGINT AS n_chars FROM w
"""


@query
def op13_resident_lloyd(spark, sf_dir):
    from fillsight.llm import codes

    return codes.compress_embeddings(table(spark, sf_dir, "embeddings"))


def _lloyd_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Codebook and assignment of every round as tables."""
    ctes = [f"""
v AS (
  SELECT row_number() OVER () AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", f"""
m AS MATERIALIZED (
  SELECT r, p, e[p * (len(e) // {parts}) + 1 : (p + 1) * (len(e) // {parts})] AS x FROM v, (SELECT unnest(range({parts})) AS p))""", f"""
b0 AS MATERIALIZED (
  SELECT p, k, x FROM m JOIN (SELECT r, row_number() OVER (ORDER BY vec_id NULLS LAST, e) - 1 AS k FROM v) USING (r) WHERE k < {entries})"""]
    for i in range(rounds + 1):
        ctes.append(f"""
a{i} AS MATERIALIZED (
  SELECT r, p, x, best.k AS k, best.d AS d FROM (
    SELECT r, p, m.x, min({{'d': list_sum(list_transform(list_zip(m.x, b.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT, 'k': b.k}}) AS best
    FROM m JOIN b{i} b USING (p) GROUP BY r, p, m.x))""")
        if i < rounds:
            ctes.append(f"""
b{i + 1} AS MATERIALIZED (
  SELECT p, k, coalesce(n.x, b.x) AS x FROM b{i} b LEFT JOIN (
    SELECT p, k, list((s - ((s % n) + n) % n) // n ORDER BY i) AS x FROM (
      SELECT p, k, i, sum(c)::BIGINT AS s, count(*) AS n FROM (SELECT p, k, unnest(x) AS c, unnest(range(len(x))) AS i FROM a{i}) GROUP BY p, k, i)
    GROUP BY p, k) n USING (p, k))""")
    return f"""WITH {",".join(ctes)},
c AS (SELECT r, string_agg(printf('%02x', k::INT), '' ORDER BY p) AS code, sum(d)::BIGINT AS error FROM a{rounds} GROUP BY r),
h AS (SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, k, i)) AS h FROM (SELECT p, k, unnest(x) AS c, unnest(range(len(x))) AS i FROM b{rounds}))
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (r), h
"""


SQL["op13_resident_lloyd"] = _lloyd_sql()
