"""The numbered queries: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, fingerprints, html, lines, minhash, packing, pieces, rules, secrets, sketches, toxicity, tries, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


def op10_pigeonhole_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_crf_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return secrets.digest(secrets.scan(documents, secrets.fit(documents)))


def op3_host_suffix_array_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op4_noisy_channel_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    return toxicity.score(documents, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op5_path_template_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(_table(spark, sf_dir, "pages").select("page_id", "url"))


def op6_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), k=4)


def op7_line_frequency_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.quality(_table(spark, sf_dir, "documents").select("doc_id", "text", "source"))


def op8_suffix_array_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def op9_fingerprint_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.substring_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_max_sketch_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketches.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_euler_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.rebuilt_trie(_table(spark, sf_dir, "conversations")).drop("enter_rank", "exit_rank")


def op13_certified_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces(_table(spark, sf_dir, "documents")))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash_line_dedup, op2_crf_secret_scan, op3_host_suffix_array_html, op4_noisy_channel_toxicity, op5_path_template_urls, op6_minmax_near_dedup, op7_line_frequency_rules, op8_suffix_array_sentencepiece, op9_fingerprint_index, op10_pigeonhole_decontamination, op11_max_sketch_search, op12_euler_prefix_trie, op13_certified_packing)}


_WORDS = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"
_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP6 = f"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(_LOWER.format("coalesce(text, '')"))} AS ws FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS x FROM w),
l AS (SELECT doc_id, len(x) AS n, unnest(x) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM l a JOIN l b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT p.b, r.root FROM r JOIN p ON r.doc_id = p.a)
SELECT s.doc_id, CAST(len(x) AS BIGINT) AS n_shingles, min(root) AS component_id, s.doc_id = min(root) AS kept FROM s JOIN r ON s.doc_id = r.doc_id GROUP BY s.doc_id, x"""

_OP9 = f"""WITH w AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, unnest(list_transform(range(1, len(ws) - 11), lambda i: array_to_string(ws[i:i + 12], ' '))) AS g FROM w WHERE len(ws) >= 13),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS first FROM win) WHERE first < doc_id),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM hit, (SELECT unnest(range(0, 13)) AS k)),
word AS (SELECT doc_id, unnest(range(1, len(ws) + 1)) AS i, unnest(ws) AS word FROM w),
kept AS (SELECT word.doc_id, string_agg(word, ' ' ORDER BY word.i) AS text, count(*) AS n FROM word LEFT JOIN gone ON word.doc_id = gone.doc_id AND word.i = gone.i WHERE gone.i IS NULL GROUP BY 1)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM w LEFT JOIN kept ON w.doc_id = kept.doc_id"""

_OP7 = f"""WITH w AS (SELECT doc_id, source, coalesce(text, '') AS text, {_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(1, len(ws) - 6)) AS i, unnest(list_transform(range(1, len(ws) - 6), lambda i: array_to_string(ws[i:i + 7], ' '))) AS g FROM w WHERE len(ws) >= 9),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM twice, (SELECT unnest(range(0, 8)) AS k) GROUP BY 1),
line AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM w),
worded AS (SELECT doc_id, source, line, len({_WORDS.format('line')}) AS size FROM line WHERE len({_WORDS.format('line')}) > 0),
dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM worded GROUP BY 1),
normal AS (SELECT doc_id, source, size, array_to_string({_WORDS.format(f"regexp_replace({_LOWER.format('line')}, '[0-9]+', '0', 'g')")}, ' ') AS line FROM worded),
common AS (SELECT source, line FROM (SELECT source, line, count(DISTINCT doc_id) AS n FROM normal GROUP BY 1, 2) JOIN (SELECT source, count(DISTINCT doc_id) AS docs FROM documents GROUP BY 1) USING (source) WHERE n > {rules.LEAST_DOCUMENTS} AND n * {rules.HOST_SHARE} > docs),
gone AS (SELECT doc_id, sum(size) AS n FROM normal JOIN common USING (source, line) GROUP BY 1),
m AS (SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(text) - length(translate(text, '#*$%&|<>', '')) AS n_symbols, coalesce(dup.n, 0) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, CAST(coalesce(gone.n, 0) AS BIGINT) AS n_line_words
 FROM w LEFT JOIN dup ON w.doc_id = dup.doc_id LEFT JOIN rep ON w.doc_id = rep.doc_id LEFT JOIN gone ON w.doc_id = gone.doc_id)
SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 100 * (n_words - n_line_words) < {rules.LEFT_PERCENT} * n_words) AS kept FROM m"""

_TERMS = r"regexp_extract_all({0}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')".format(_LOWER.format("coalesce(text, '')"))

_OP11 = f"""WITH d AS (SELECT doc_id, {_TERMS} AS ws FROM documents), c AS (SELECT count(*) FILTER (len(ws) > 0) AS n, CAST(sum(len(ws)) AS BIGINT) AS l FROM d),
q AS (SELECT DISTINCT item_id, unnest({_TERMS}) AS term FROM benchmark),
t AS (SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS n, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
w AS (SELECT term, CAST(floor(1000 * ln((2 * (SELECT n FROM c) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM t GROUP BY term),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * t.n * c.n) // c.l)))) AS BIGINT) AS score FROM t JOIN w USING (term) JOIN q USING (term) CROSS JOIN c GROUP BY 1, 2),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= {sketches.K}"""

_CRC32 = "xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({0} AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))), lambda a, b: list_reduce(list_prepend(xor(a, b), range(8)), lambda x, i: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)))"

_OP12 = f"""WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, count(*) AS own, {_CRC32.format('conv_id')} % 6 AS h, conv_id - conv_id % 100 AS base FROM t GROUP BY conv_id),
k AS (SELECT c.conv_id, c.h, c.base, least(c.h, coalesce(b.own, 0)) AS k FROM c LEFT JOIN c b ON b.conv_id = c.base),
r AS (SELECT k.conv_id, pos AS depth, role, text FROM k JOIN t ON t.conv_id = k.base WHERE pos <= k.k UNION ALL SELECT k.conv_id, k.k + pos - h, role, text FROM k JOIN t ON t.conv_id = k.conv_id WHERE pos > h),
p AS (SELECT conv_id, depth, string_agg(md5(role || chr(1) || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS key, length(text) AS chars FROM r UNION ALL SELECT conv_id, 0, '', 0 FROM k),
n AS (SELECT depth, key, left(key, 32 * (depth - 1)) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS gain FROM p GROUP BY depth, key),
kids AS (SELECT depth - 1 AS depth, above AS key, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1, 2),
x AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN kids ON kids.depth = n.depth AND kids.key = n.key),
s AS (SELECT a.depth, a.key, count(*) FILTER (x.n_children = 0) AS n_leaves, sum(gain) AS saved FROM x JOIN p a ON a.conv_id = x.conv_id AND a.depth <= x.depth GROUP BY 1, 2),
e AS (SELECT depth, key, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends FROM (SELECT conv_id, depth, key, max(depth) OVER (PARTITION BY conv_id) AS last FROM p) WHERE depth = last GROUP BY 1, 2)
SELECT x.conv_id, CAST(x.depth AS BIGINT) AS depth, up.conv_id AS parent_conv_id, x.n_convs, x.n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM x JOIN s ON s.depth = x.depth AND s.key = x.key LEFT JOIN x up ON up.depth = x.depth - 1 AND up.key = x.above LEFT JOIN e ON e.depth = x.depth AND e.key = x.key"""


def _op5() -> str:
    fits = [(h + p, v, f"(host = '{h}' OR host LIKE '%.{h}') AND starts_with(path, '{p}')") for h, p, v in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))]
    case = lambda i: "CASE " + " ".join(f"WHEN {f[2]} THEN '{f[i]}'" for f in fits) + " END"
    kind = "CASE WHEN regexp_matches(s, '^[0-9]+([.][a-z]+)?$') OR regexp_matches(s, '^[0-9a-f-]{8,}$') OR regexp_matches(s, '[0-9].*[a-zA-Z_-].*[0-9]') THEN '*' ELSE lower(s) END"
    out = [
        f"""p AS (SELECT page_id, {_LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")} AS host, regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM (SELECT page_id, coalesce(url, '') AS url FROM pages))""",
        f"k AS (SELECT *, {case(0)} AS rule, {case(1)} AS by_rule, list_transform(list_filter(string_split(path, '/'), lambda s: s <> ''), lambda s: {kind}) AS kinds FROM p)",
        f"r AS (SELECT * EXCLUDE (kinds), array_to_string(CASE WHEN len(kinds) > {urls.DEPTH} THEN list_append(kinds[1:{urls.DEPTH}], array_to_string(kinds[{urls.DEPTH + 1}:], '>')) ELSE kinds END, '/') AS shape FROM k)",
        "h AS (SELECT host, shape, count(*) AS n, count(*) FILTER (by_rule = 'block') AS b, count(by_rule) AS l FROM r GROUP BY 1, 2)",
        f"t0 AS (SELECT *, '' AS template, sum(b) OVER w / (sum(l) OVER w + {urls.SMOOTHING}) AS p, sum(b) OVER w / (sum(n) OVER w + {urls.SMOOTHING}) AS q FROM h WINDOW w AS (PARTITION BY host))",
    ]
    for i in range(urls.DEPTH + 1):
        out += [
            f"s{i} AS (SELECT *, coalesce(string_split(shape, '/')[{i + 1}], '') AS segment FROM t{i})",
            f"c{i} AS (SELECT host, template, segment, sum(n) AS n, sum(b) AS b, sum(l) AS l, min(p) AS p, min(q) AS q FROM s{i} GROUP BY 1, 2, 3)",
            f"d{i} AS (SELECT *, sum(n) OVER w AS pn, sum(b) OVER w / greatest(sum(l) OVER w, 1) AS share FROM c{i} WINDOW w AS (PARTITION BY host, template))",
            f"""b{i} AS (SELECT host, template, segment, n, b, l, p, q, CASE WHEN segment = '' OR NOT (n >= {urls.NAMED_SHARE} * pn AND n >= {urls.NAMED_LEAST}) OR segment = '*' THEN CASE WHEN segment = '' THEN '' ELSE '*' END
	 WHEN l > 0 AND abs(b / greatest(l, 1) - share) <= {urls.ALIKE_Z} * sqrt(greatest(share * (1 - share), 0.01) / greatest(l, 1)) THEN '~' ELSE segment END AS branch FROM d{i})""",
            f"n{i} AS (SELECT host, template, segment, branch, CASE WHEN branch = '' THEN min(p) OVER w ELSE (sum(b) OVER w + {urls.SMOOTHING} * min(q) OVER w) / (sum(l) OVER w + {urls.SMOOTHING}) END AS p, CASE WHEN branch = '' OR sum(l) OVER w = 0 THEN min(q) OVER w ELSE (sum(b) OVER w + {urls.SMOOTHING} * min(q) OVER w) / (sum(n) OVER w + {urls.SMOOTHING}) END AS q FROM b{i} WINDOW w AS (PARTITION BY host, template, branch))",
            f"t{i + 1} AS (SELECT s.host, shape, s.n, s.b, s.l, CASE WHEN s.segment = '' THEN s.template ELSE s.template || '/' || branch END AS template, x.p, x.q FROM s{i} s JOIN n{i} x ON s.host = x.host AND s.template = x.template AND s.segment = x.segment)",
        ]
    last = f"t{urls.DEPTH + 1}"
    return f"""WITH {", ".join(out)} SELECT page_id, r.host, path, rule, coalesce(by_rule, CASE WHEN p >= {urls.REJECT} THEN 'block' ELSE 'allow' END) AS verdict, template, CAST(p AS DOUBLE) AS purity FROM r JOIN {last} t ON r.host = t.host AND r.shape = t.shape"""


def oracle_sql() -> dict[str, str]:
    """Of those that SQL can express; the others' tests are in tests/llm."""
    return {"op5_path_template_urls": _op5(), "op6_minmax_near_dedup": _OP6, "op7_line_frequency_rules": _OP7, "op9_fingerprint_index": _OP9, "op11_max_sketch_search": _OP11, "op12_euler_prefix_trie": _OP12}
