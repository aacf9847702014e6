"""The queries of these operators over the driver's tables, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirelens.llm import exact, lines, mixing, packing, pii, quality, simhash, spelling, topk, toxicity, urls, warc, whitening
from quirelens.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
TOKENIZER = "word_bpe_49k.json"


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where the public tokenizers' package keeps a file; the same on every machine of the cluster."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


@query("op1_top_k", """
    WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
      FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
        AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
    SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
""")
def op1(spark, sf_dir):
    return topk.top_k(table(spark, sf_dir, "embeddings"))


@query("op2_line_dedup")
def op2(spark, sf_dir):
    return lines.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "text", "blocks")


@query("op3_packing")
def op3(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_mixing", f"""
    WITH d AS (
      SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    w AS (
      SELECT *, [3.0, 1.0, 2.0][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight FROM s),
    l AS (SELECT *, source_size * 2.0::DOUBLE AS lim FROM w),
    o AS (
      SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS done,
        sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS others,
        CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE AS budget FROM l),
    t AS (SELECT source, source_size, least(lim, max((budget - done) / others) OVER () * weight) AS target FROM o),
    n AS (
      SELECT d.*, t.source_size, t.target, row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id NULLS LAST) AS k,
        CAST(floor(CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END * 16777216 + 0.5) AS BIGINT) AS each
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, source, size, source_size, target,
      (k * each + {mixing.offset_of(mixing.SEED)}) // 16777216 - ((k - 1) * each + {mixing.offset_of(mixing.SEED)}) // 16777216 AS copies,
      size * ((k * each + {mixing.offset_of(mixing.SEED)}) // 16777216 - ((k - 1) * each + {mixing.offset_of(mixing.SEED)}) // 16777216) AS taken
    FROM n
""")
def op4(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


@query("op5_simhash")
def op5(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6(spark, sf_dir):
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_warc", """
    WITH p AS (
      SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
    f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
    SELECT page_id, payload_bytes, payload_digest,
      CASE WHEN first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN first_id <> page_id THEN first_id END AS refers_to
    FROM p LEFT JOIN f USING (payload_digest)
""")
def op7(spark, sf_dir):
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op8_exact_dedup", """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
    g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
    SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(t) AS text_sha256
    FROM d JOIN g USING (t)
""")
def op8(spark, sf_dir):
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


@query("op9_pii")
def op9(spark, sf_dir):
    return pii.pseudonymize(table(spark, sf_dir, "documents")).select("doc_id", "text", F.to_json("found").alias("found"))


def _url_sql(depth: int = 6, rare: int = 2, many: int = 32, z2: float = 3.84, strength: float = 4.0, reject: float = 0.8) -> str:
    """The tree level by level, for paths of fewer than ``depth`` segments, more than the given tables' have."""

    def rule(column):
        out = "NULL"
        for verdict, text in sorted(urls.RULES, key=lambda r: (len(r[1]), r[1])):
            domain, _, rest = text.partition("/")
            value = text if column == "rule" else verdict
            out = f"CASE WHEN (host = '{domain}' OR host LIKE '%.{domain}') AND starts_with(path, '/{rest}') THEN '{value}' ELSE {out} END"
        return out

    text = f"""
    WITH u AS (SELECT page_id, coalesce(url, '') AS url FROM pages),
    p AS (
      SELECT page_id, translate(regexp_extract(url, '{urls.PARTS}', 1), '{urls.UPPER}', '{urls.LOWER}') AS host,
        regexp_extract(url, '{urls.PARTS}', 2) AS path FROM u),
    rows AS (SELECT *, {rule('rule')} AS rule, {rule('verdict')} AS ruled FROM p),
    r0 AS (
      SELECT host, path, string_split(substr(path, 2), '/') AS segs, '' AS template, count(*) AS n, count(ruled) AS lab,
        count(*) FILTER (WHERE ruled = 'block') AS bad, false AS rests
      FROM rows GROUP BY host, path)"""
    for k in range(1, depth + 1):
        own = "seg IS NOT NULL AND NOT is_id"
        text += f""",
    a{k} AS (SELECT *, segs[{k}] AS seg FROM r{k - 1} WHERE NOT rests),
    c{k} AS (
      SELECT host, template, seg, sum(n) AS cn, sum(lab) AS cl, sum(bad) AS cb, count(*) AS paths, coalesce(regexp_matches(seg, '{urls.ID_LIKE}'), false) AS is_id
      FROM a{k} GROUP BY host, template, seg),
    n{k} AS (
      SELECT host, template, sum(paths) AS everything, count(*) FILTER (WHERE {own} AND cn <= {rare}) AS kinds,
        coalesce(sum(cl) FILTER (WHERE {own} AND cn > {rare}), 0) AS fl, coalesce(sum(cb) FILTER (WHERE {own} AND cn > {rare}), 0) AS fb,
        coalesce(sum(cl) FILTER (WHERE {own} AND cn <= {rare}), 0) AS rl, coalesce(sum(cb) FILTER (WHERE {own} AND cn <= {rare}), 0) AS rb
      FROM c{k} GROUP BY host, template),
    z{k} AS (
      SELECT c.*, everything, is_id OR (cn <= {rare} AND kinds >= {many}) AS variable, cl::DOUBLE AS n1, cb::DOUBLE AS b1,
        (fl + CASE WHEN kinds >= {many} THEN 0 ELSE rl END - cl)::DOUBLE AS n0, (fb + CASE WHEN kinds >= {many} THEN 0 ELSE rb END - cb)::DOUBLE AS b0
      FROM c{k} c JOIN n{k} n ON c.host = n.host AND c.template = n.template),
    d{k} AS (
      SELECT host, template, seg, everything = 1 AS single, seg IS NULL OR everything = 1 OR (NOT variable AND cl = 0) AS rests,
        CASE WHEN variable THEN '*' WHEN cl = 0 THEN seg || '/**' WHEN n0 <= 0 THEN seg
          WHEN pow(b1 / n1 - b0 / n0, 2) > {z2}::DOUBLE * ((b1 + b0) / (n1 + n0)) * (1 - (b1 + b0) / (n1 + n0)) * (1 / n1 + 1 / n0) THEN seg ELSE '+' END AS part
      FROM z{k}),
    r{k} AS (
      SELECT a.host, path, segs, CASE WHEN a.seg IS NULL THEN a.template WHEN single THEN a.template || '/' || array_to_string(list_slice(segs, {k}, len(segs)), '/')
        ELSE a.template || '/' || part END AS template, n, lab, bad, d.rests
      FROM a{k} a JOIN d{k} d ON a.host = d.host AND a.template = d.template AND a.seg IS NOT DISTINCT FROM d.seg)"""
    every = " UNION ALL ".join(f"SELECT host, path, template, lab, bad FROM r{k} WHERE rests" for k in range(1, depth + 1))
    return text + f""",
    leaf AS ({every}),
    b AS (SELECT coalesce(sum(bad)::DOUBLE / nullif(sum(lab), 0), 0) AS base FROM leaf),
    v AS (SELECT host, template, sum(lab) AS l, (sum(bad) + {strength}::DOUBLE * any_value(base)) / (sum(lab) + {strength}::DOUBLE) AS purity FROM leaf, b GROUP BY host, template)
    SELECT page_id, r.host, r.path, rule, coalesce(ruled, CASE WHEN l > 0 AND purity >= {reject}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict,
      t.template, purity
    FROM rows r JOIN leaf t ON r.host = t.host AND r.path = t.path JOIN v ON t.host = v.host AND t.template = v.template"""


@query("op10_url_filter", _url_sql())
def op10(spark, sf_dir):
    return urls.judge(table(spark, sf_dir, "pages"))


@query("op11_whitening")
def op11(spark, sf_dir):
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def _quality_sql() -> str:
    share, error, lift = f"{quality.SHARE}::DOUBLE", f"{quality.ERROR}::DOUBLE", f"{quality.LIFT}::DOUBLE"
    quoted = lambda chars: chars.replace("'", "''")
    values = {
        "symbols": "n_symbols::DOUBLE / greatest(word_chars, 1)", "marks": "n_marks::DOUBLE / greatest(word_chars, 1)",
        "capitals": "n_capitals::DOUBLE / greatest(word_chars, 1)", "dup_lines": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
        "repeats": "n_repeat_words::DOUBLE / greatest(n_words, 1)", "long_words": "word_chars::DOUBLE / greatest(n_words, 1)",
        "short_words": "-(word_chars::DOUBLE / greatest(n_words, 1))", "long_lines": "n_words::DOUBLE / greatest(n_lines, 1)",
    }
    assert list(values) == list(quality.RULES)
    return f"""
    WITH d AS (SELECT row_number() OVER () AS r, doc_id, lang, coalesce(text, '') AS t FROM documents),
    a AS (
      SELECT r, doc_id, lang, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
        list_filter(string_split(t, chr(10)), lambda s: regexp_matches(s, '[^\x20\x09-\x0D]')) AS l FROM d),
    win AS (
      SELECT r, i, list_slice(w, i, i + 7) AS x FROM (SELECT r, w, unnest(range(1, CAST(len(w) AS BIGINT) - 6)) AS i FROM a WHERE len(w) > 8)),
    twice AS (SELECT r, x FROM win GROUP BY r, x HAVING count(*) > 1),
    hit AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS j FROM win JOIN twice USING (r, x)),
    rep AS (SELECT r, CAST(sum(least(8, coalesce(j - i, 8))) AS BIGINT) AS n_repeat_words FROM hit GROUP BY r),
    m AS (
      SELECT doc_id, lang, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(t) - length(translate(t, '{quoted(quality.SYMBOLS)}', '')) AS BIGINT) AS n_symbols,
        CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
        CAST(len(l) AS BIGINT) AS n_lines,
        CAST(length(t) - length(translate(t, '{quoted(quality.MARKS)}', '')) AS BIGINT) AS n_marks,
        CAST(length(t) - length(translate(t, '{quality.CAPITALS}', '')) AS BIGINT) AS n_capitals
      FROM a LEFT JOIN rep USING (r)),
    b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m),
    q AS (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IN (0, 1) GROUP BY doc_id),
    v AS (
      SELECT lang, left(md5(CAST(b.doc_id AS VARCHAR)), 1) < '8' AS choosing, quality, unnest([{
        ", ".join(f"{{'rule': '{k}', 'value': {x}}}" for k, x in values.items())}], recursive := true)
      FROM b JOIN q ON b.doc_id = q.doc_id WHERE NOT base_failed),
    n AS (SELECT lang, choosing, rule, sum(quality) AS n_good, sum(1 - quality) AS n_bad FROM v GROUP BY ALL),
    counted AS (SELECT lang, choosing, rule, value, sum(quality) AS good FROM v GROUP BY lang, choosing, rule, value),
    above AS (
      SELECT lang, choosing, rule, value,
        coalesce(sum(good) OVER (PARTITION BY lang, choosing, rule ORDER BY value DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS above
      FROM counted),
    c AS (
      SELECT x.lang, x.rule, n_good, n_bad, min(value) AS cut_at
      FROM above x JOIN n ON x.lang IS NOT DISTINCT FROM n.lang AND x.rule = n.rule AND n.choosing
      WHERE x.choosing AND above <= floor({share} / {len(values)} * n_good) GROUP BY ALL),
    e AS (
      SELECT c.lang, c.rule, n_good, n_bad, count(*) FILTER (WHERE value > cut_at AND quality = 1) AS g, count(*) FILTER (WHERE value > cut_at AND quality = 0) AS h
      FROM c JOIN v ON c.lang IS NOT DISTINCT FROM v.lang AND c.rule = v.rule AND v.choosing GROUP BY ALL),
    chosen AS (
      SELECT lang, rule, count(*) OVER (PARTITION BY lang) AS r, count(*) OVER () AS t FROM e WHERE h > 0 AND h * n_good >= {lift} * g * n_bad),
    trial AS (
      SELECT x.lang, x.rule, n.n_good, {share} / r AS p, {error} / t AS err
      FROM chosen x JOIN n ON x.lang IS NOT DISTINCT FROM n.lang AND x.rule = n.rule AND NOT n.choosing),
    terms AS (SELECT *, unnest(range(0, CAST(floor(n_good * p) AS BIGINT) + 1)) AS k FROM trial WHERE n_good > 0),
    tail AS (
      SELECT *, sum(exp(lgamma(n_good + 1) - lgamma(k + 1) - lgamma(n_good - k + 1) + k * ln(p) + (n_good - k) * ln(1 - p)))
        OVER (PARTITION BY lang, rule ORDER BY k) AS chance FROM terms),
    bound AS (SELECT lang, rule, max(k) AS k FROM tail WHERE chance <= err GROUP BY ALL),
    cutoffs AS (
      SELECT x.lang, x.rule, min(value) AS cutoff
      FROM above x JOIN bound y ON x.lang IS NOT DISTINCT FROM y.lang AND x.rule = y.rule WHERE NOT choosing AND above <= k GROUP BY ALL),
    wide AS (SELECT lang, {", ".join(f"max(cutoff) FILTER (WHERE rule = '{k}') AS c_{k}" for k in values)} FROM cutoffs GROUP BY lang),
    judged AS (
      SELECT b.*, concat_ws(',', {", ".join(f"CASE WHEN {x} > c_{k} THEN '{k}' END" for k, x in values.items())}) AS failed_rules
      FROM b LEFT JOIN wide ON b.lang IS NOT DISTINCT FROM wide.lang)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_marks, n_capitals, base_failed, failed_rules,
      NOT base_failed AND failed_rules = '' AS kept FROM judged"""


@query("op12_quality_rules", _quality_sql())
def op12(spark, sf_dir):
    return quality.quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


# Half-bytes of the crc32 polynomial's table: the rule is eight shifts, four of which one entry covers.
def _crc_steps() -> list[int]:
    out = []
    for i in range(16):
        for _ in range(4):
            i = i >> 1 ^ (0xEDB88320 if i & 1 else 0)
        out.append(i)
    return out


@query("op13_spelling_variants", f"""
    WITH RECURSIVE run AS (
      SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{spelling.UPPER}', '{spelling.LOWER}') AS run FROM documents),
    once AS (SELECT doc_id, run, count(*) AS n FROM run WHERE length(run) >= 6 GROUP BY ALL),
    hexed AS (SELECT *, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS x FROM once),
    hashed AS (
      SELECT run, n, xor(4294967295, list_reduce(
        list_prepend(4294967295::BIGINT, list_transform(range(CAST(length(x) AS BIGINT)), lambda i: instr('0123456789ABCDEF', substr(x, CAST(xor(i, 1) AS BIGINT) + 1, 1))::BIGINT - 1)),
        lambda c, v: xor(c >> 4, {_crc_steps()}[CAST(xor(c & 15, v) AS BIGINT) + 1]::BIGINT))) AS h FROM hexed),
    named AS (
      SELECT CASE WHEN h % {spelling.DAMAGE} = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2) ELSE run END AS word, n
      FROM hashed),
    vocab AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM named WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
    hole AS (
      SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS short
      FROM (SELECT word, unnest(range(1, CAST(length(word) AS BIGINT) + 1)) AS i FROM vocab)),
    near AS (
      SELECT a.word, b.word AS other FROM hole a JOIN hole b ON a.i = b.i AND a.short = b.short AND a.word <> b.word
      UNION SELECT h.word, v.word FROM hole h JOIN vocab v ON v.word = h.short
      UNION SELECT v.word, h.word FROM hole h JOIN vocab v ON v.word = h.short),
    ranked AS (
      SELECT near.word, other, n, count(*) OVER (PARTITION BY near.word) AS n_near,
        row_number() OVER (PARTITION BY near.word ORDER BY n DESC, other) AS k FROM near JOIN vocab ON vocab.word = other),
    formed AS (
      SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN r.n >= 5 * v.n THEN other END AS form, CASE WHEN r.n >= 5 * v.n THEN r.n END AS form_n
      FROM vocab v LEFT JOIN ranked r ON r.word = v.word AND k = 1),
    chain AS (
      SELECT word, word AS at FROM formed UNION ALL
      SELECT c.word, f.form FROM chain c JOIN formed f ON f.word = c.at WHERE f.form IS NOT NULL)
    SELECT f.word, f.form, c.at AS root, f.n, CAST(f.n_near AS BIGINT) AS n_near, f.form_n
    FROM formed f JOIN chain c ON c.word = f.word JOIN formed e ON e.word = c.at AND e.form IS NULL
""")
def op13(spark, sf_dir):
    return spelling.spelling_variants(table(spark, sf_dir, "documents"))
