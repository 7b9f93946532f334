"""The queries ``opN_<name>``: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnscope.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE[name] = sql
        return fn

    return add


@query(
    "op3_decontaminate",
    r"""
    WITH words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
    item_words AS (
      SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
    item_windows AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS m, w[p:p + least(len(w), 10) - 1] AS win
      FROM item_words, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS s(p) WHERE len(w) > 0),
    lengths AS (SELECT DISTINCT m FROM item_windows),
    doc_windows AS (
      SELECT doc_id, m, p, w[p:p + m - 1] AS win
      FROM words, lengths, unnest(generate_series(1, len(w) - m + 1)) AS s(p) WHERE len(w) >= m),
    found AS (SELECT d.doc_id, d.m, d.p, i.item_id FROM doc_windows d JOIN item_windows i ON d.m = i.m AND d.win = i.win),
    hit AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT DISTINCT doc_id, m, p FROM found) f,
            unnest(generate_series(p, p + m - 1)) AS s(q) GROUP BY doc_id),
    its AS (SELECT doc_id, list_sort(list(DISTINCT cast(item_id AS varchar))) AS items FROM found GROUP BY doc_id)
    SELECT w.doc_id, cast(len(w.w) AS bigint) AS n_words, cast(coalesce(hit.n, 0) AS bigint) AS n_hit,
           cast(coalesce(len(its.items), 0) AS bigint) AS n_items,
           sha256(coalesce(array_to_string(its.items, ','), '')) AS items_sha256, coalesce(hit.n, 0) > 0 AS contaminated
    FROM words w LEFT JOIN hit ON w.doc_id = hit.doc_id LEFT JOIN its ON w.doc_id = its.doc_id
    """,
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.decontaminate import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query("op4_quotation_linking")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.quotes import reply_ordered

    return reply_ordered(table(spark, sf_dir, "conversations"))


@query("op5_systematic_mix")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.mixing import mix

    return mix(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source", "copies"
    )


@query("op7_host_reputation")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's outcome is the label of the document with its id: good if of quality and not toxic."""
    from churnscope.llm.hosts import judge

    outcomes = table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("page_id"), ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("good")
    )
    return judge(table(spark, sf_dir, "pages"), outcomes).select("page_id", "host", "path", "rule", "verdict", "lower")


@query(
    "op10_jaccard_join",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    grams AS (
      SELECT DISTINCT doc_id, w[p:p + least(len(w), 4) - 1] AS g
      FROM words, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS s(p) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common_grams AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
    links AS (
      SELECT x, y FROM common_grams JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
      WHERE 100 * o >= 85 * (a.n + b.n - o)),
    reach AS (
      SELECT doc_id AS d, doc_id AS r FROM sizes
      UNION SELECT reach.d, links.y FROM reach JOIN links ON reach.r = links.x)
    SELECT w.doc_id, cast(coalesce(s.n, 0) AS bigint) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id
    FROM words w LEFT JOIN sizes s ON w.doc_id = s.doc_id
    LEFT JOIN (SELECT d, min(r) AS component_id FROM reach GROUP BY d) c ON w.doc_id = c.d
    """,
)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.jaccard import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


@query(
    "op6_substring_dedup",
    r"""
    WITH words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
      FROM documents),
    windows AS (
      SELECT doc_id, p, md5(array_to_string(w[p:p + 49], ' ')) AS h
      FROM words, unnest(generate_series(1, len(w) - 49)) AS s(p) WHERE len(w) >= 50),
    lowest AS (SELECT h, min(doc_id) AS lo FROM windows GROUP BY h),
    gone AS (
      SELECT DISTINCT doc_id, q FROM windows JOIN lowest USING (h), unnest(generate_series(p, p + 49)) AS s(q) WHERE doc_id > lo),
    lost AS (SELECT doc_id, list(q) AS qs FROM gone GROUP BY doc_id),
    kept AS (
      SELECT words.doc_id, len(w) AS n, coalesce(len(qs), 0) AS r,
             CASE WHEN qs IS NULL THEN w
                  ELSE list_transform(list_filter(generate_series(1, len(w)), lambda i: NOT list_contains(qs, i)), lambda i: w[i]) END AS k
      FROM words LEFT JOIN lost ON words.doc_id = lost.doc_id)
    SELECT doc_id, cast(n AS bigint) AS n_words, cast(r AS bigint) AS n_removed,
           sha256(coalesce(array_to_string(k, ' '), '')) AS kept_sha256 FROM kept
    """,
)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.substrings import substring_dedup

    return substring_dedup(table(spark, sf_dir, "documents")).drop("_k")


@query("op2_quality_rules")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.quality import quality

    found = quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability"
    )


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query("op8_token_output")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.tokens import read_tokens, write_tokens

    return read_tokens(spark, write_tokens(table(spark, sf_dir, "documents"), tokenizer_file()))


@query(
    "op9_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
    d AS (SELECT page_id, strlen(body) AS n, sha1(body) AS h FROM p),
    m AS (SELECT h, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY h)
    SELECT page_id, cast(n AS bigint) AS payload_bytes, d.h AS payload_digest,
           CASE WHEN last > page_id THEN 'revisit' ELSE 'response' END AS record_type,
           CASE WHEN last > page_id THEN last END AS refers_to
    FROM d LEFT JOIN m ON d.h = m.h AND n >= 1000
    """,
)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests and lengths of responses are taken anew from their payloads; revisits carry their response's."""
    from churnscope.llm.warc import page_of, read_warc, write_warc

    records = read_warc(spark, write_warc(table(spark, sf_dir, "pages")))
    response = F.col("record_type") == "response"
    return records.select(
        page_of(F.col("record_id")).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(response, F.sha1("payload")).otherwise(F.col("sha1")).alias("payload_digest"),
        "record_type",
        page_of(F.col("refers_to_id")).alias("refers_to"),
    )


@query("op1_ppm_score")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.ppm import ppm_score

    return ppm_score(table(spark, sf_dir, "documents"), F.crc32(F.col("doc_id").cast("string")) % 7 != 2)


@query(
    "op13_tensored_minhash",
    r"""
    WITH RECURSIVE words AS (
      SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
    grams AS (
      SELECT DISTINCT doc_id, w[p:p + least(len(w), 5) - 1] AS g
      FROM words, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS s(p) WHERE len(w) > 0),
    sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    common_grams AS (
      SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY 1, 2),
    links AS (
      SELECT x, y FROM common_grams JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y
      WHERE 100 * o >= 85 * (a.n + b.n - o)),
    reach AS (
      SELECT doc_id AS d, doc_id AS r FROM sizes
      UNION SELECT reach.d, links.y FROM reach JOIN links ON reach.r = links.x),
    found AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d)
    SELECT w.doc_id, cast(coalesce(s.n, 0) AS bigint) AS n_shingles, coalesce(c.component_id, w.doc_id) AS component_id,
           coalesce(c.component_id, w.doc_id) = w.doc_id AS kept
    FROM words w LEFT JOIN sizes s ON w.doc_id = s.doc_id LEFT JOIN found c ON w.doc_id = c.d
    """,
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.tensor import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("_k")


#: Unsigned crc32 of the ASCII text ``{0}`` in DuckDB, bit by bit.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({0}, ''), lambda c: ascii(c)::bigint)),
             lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
             lambda x, _: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295)"""


@query(
    "op11_periodic_runs",
    r"""
    WITH plain AS (
      SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
             """ + _CRC32.format("cast(doc_id AS varchar)") + r""" AS h
      FROM documents),
    spots AS (SELECT *, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM plain),
    words AS (
      SELECT doc_id, CASE WHEN h % 10 = 0 AND len(w) > 0
             THEN list_transform(generate_series(0, len(w) - 1), lambda i: w[1 + CASE WHEN i < a THEN i
                                 ELSE a + (i - a) % (1 + (len(w) - a) // (3 + (h // 10) % 8)) END])
             ELSE w END AS w
      FROM spots),
    grams AS (
      SELECT doc_id, i, w[i + 1:i + 6] AS g FROM words, unnest(generate_series(0, len(w) - 6)) AS s(i) WHERE len(w) >= 6),
    equal AS (
      SELECT x.doc_id, x.i, y.i - x.i AS q, x.i - row_number() OVER (PARTITION BY x.doc_id, y.i - x.i ORDER BY x.i) AS island
      FROM grams x JOIN grams y ON x.doc_id = y.doc_id AND x.g = y.g AND x.i < y.i),
    stretches AS (SELECT doc_id, q, min(i) AS s, count(*) + 5 AS m FROM equal GROUP BY doc_id, q, island),
    runs AS (SELECT doc_id, s, m + q AS n, min(q) AS q FROM stretches WHERE m >= q AND m + q >= 12 GROUP BY doc_id, s, m + q),
    totals AS (
      SELECT doc_id, count(*) AS n_runs, arg_min({'s': s, 'n': n, 'q': q}, {'n': -n, 's': s, 'q': q}) AS top,
             string_agg(s || ',' || n || ',' || q || chr(10), '' ORDER BY s, q) AS lines
      FROM runs GROUP BY doc_id),
    gone AS (SELECT DISTINCT doc_id, i FROM runs, unnest(generate_series(s + q, s + n - 1)) AS t(i)),
    kept AS (
      SELECT u.doc_id, string_agg(u.v, ' ' ORDER BY u.i) AS text
      FROM (SELECT doc_id, unnest(w) AS v, unnest(generate_series(0, len(w) - 1)) AS i FROM words WHERE len(w) > 0) u
      ANTI JOIN gone ON u.doc_id = gone.doc_id AND u.i = gone.i GROUP BY u.doc_id)
    SELECT w.doc_id, coalesce(n_runs, 0) AS n_runs, top.s AS start, cast(top.n AS bigint) AS length, top.q AS period,
           cast(1000 * top.n // top.q AS bigint) AS exponent_milli,
           sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
    FROM words w LEFT JOIN totals t ON w.doc_id = t.doc_id LEFT JOIN kept ON w.doc_id = kept.doc_id
    """,
)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth document by hash has its words repeated from some word on, as the contract of this query says."""
    from churnscope.llm.runs import periodic_runs

    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("h", F.crc32(F.col("doc_id").cast("string")))
    docs = docs.withColumn("w", F.when(F.col("h") % 10 == 0, F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda x: x != "")))
    docs = docs.withColumn("n", F.size("w")).withColumn("g", F.floor(F.col("h") / 10)).withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")))
    docs = docs.withColumn("p", F.floor((F.col("n") - F.col("a")) / (F.col("g") % 8 + 3)) + 1)
    source = F.transform(
        F.sequence(F.lit(0).cast("long"), F.col("n") - F.lit(1).cast("long")),
        lambda i: F.get("w", F.when(i < F.col("a"), i).otherwise(F.col("a") + (i - F.col("a")) % F.col("p")).cast("int")),
    )
    found = periodic_runs(docs.select("doc_id", F.when(F.col("n") > 0, F.array_join(source, " ")).otherwise(F.col("text")).alias("text")))
    order = F.array_sort(F.transform("runs", lambda x: F.struct((-x["length"]).alias("l"), x["start"].alias("s"), x["period"].alias("p"))))
    top = F.get(order, F.lit(0))
    lines = F.array_join(F.transform("runs", lambda x: F.concat_ws(",", x["start"], x["length"], x["period"])), "\n")
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("top.s").alias("start"),
        (-F.col("top.l")).alias("length"),
        F.col("top.p").alias("period"),
        F.floor(F.col("top.l") * -1000 / F.col("top.p")).alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query(
    "op12_stratified_search",
    r"""
    WITH split AS (
      SELECT doc_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM documents),
    asked AS (
      SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
             'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda x: x <> '')) AS t FROM benchmark),
    posts AS (SELECT doc_id, t, count(*) AS tf FROM split GROUP BY doc_id, t),
    lens AS (SELECT doc_id, cast(sum(tf) AS bigint) AS n FROM posts GROUP BY doc_id),
    total AS (SELECT count(*) AS docs, cast(sum(n) AS bigint) AS terms FROM lens),
    norms AS (SELECT doc_id, 50 + (50 * n * docs) // terms AS m FROM lens, total),
    weights AS (SELECT t, cast(floor(1000 * ln((2 * docs + 2) / (2 * count(*) + 1))) AS bigint) AS w FROM posts, total GROUP BY t, docs),
    scores AS (
      SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS bigint) AS score
      FROM asked JOIN posts USING (t) JOIN weights USING (t) JOIN norms USING (doc_id) GROUP BY item_id, doc_id),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS r FROM scores WHERE score > 0)
    SELECT item_id, cast(r AS integer) AS rank, doc_id, score FROM ranked WHERE r <= 50
    """,
)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from churnscope.llm.strata import ranked_search

    return ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
