"""The operators applied to the given tables: thin steps from table columns to the operators' and back."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kerbside.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        QUERIES[name] = run
        if sql:
            ORACLE_SQL[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as alerts: their id and description."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("alert_id"), F.col("text").alias("description"))


def digest(text) -> F.Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


# --- 4: best-fit packing -------------------------------------------------------------------------------
@query("op4_best_fit_packing")
def op4(spark, sf_dir):
    import public_tokenizers
    from kerbside.llm.packing import pack_announcements
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("route_id"), "text")
    packed = pack_announcements(texts, public_tokenizers.path("word_bpe_49k.json"))
    return packed.withColumnRenamed("route_id", "doc_id")


# --- 8: SimHash near-dedup ------------------------------------------------------------------------------
@query("op8_simhash")
def op8(spark, sf_dir):
    from kerbside.llm.simhash import near_groups
    return near_groups(alerts(spark, sf_dir)).select(F.col("alert_id").alias("doc_id"), "fingerprint",
                                                     F.col("group_id").alias("component_id"))


# --- 9: line dedup --------------------------------------------------------------------------------------
@query("op9_line_dedup", """
WITH lines AS (
  SELECT doc_id, pos, list_extract(parts, pos) AS line FROM (
    SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents) d, unnest(range(1, len(parts) + 1)) AS u(pos)),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
shared AS (
  SELECT k, min(doc_id) AS first FROM keyed WHERE length(k) >= 10 GROUP BY k HAVING count(DISTINCT doc_id) >= 2),
marked AS (SELECT keyed.*, coalesce(doc_id > first, false) AS dropped FROM keyed LEFT JOIN shared USING (k))
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE dropped))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id""")
def op9(spark, sf_dir):
    from kerbside.llm.lines import drop_repeated_lines
    kept = drop_repeated_lines(alerts(spark, sf_dir))
    return kept.select(F.col("alert_id").alias("doc_id"), "n_lines", "n_dropped", digest(F.col("description")).alias("kept_sha256"))


# --- 1: substring dedup ---------------------------------------------------------------------------------
@query("op1_substring_dedup", r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (
  SELECT doc_id, pos, array_to_string(list_slice(w, pos, pos + 12), ' ') AS passage
  FROM words, unnest(range(1, len(w) - 11)) AS u(pos)),
firsts AS (SELECT passage, min(doc_id) AS first FROM starts GROUP BY passage HAVING count(DISTINCT doc_id) > 1),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(pos, pos + 13)) AS pos
  FROM starts JOIN firsts USING (passage) WHERE doc_id > first),
placed AS (SELECT doc_id, pos, list_extract(w, pos) AS word FROM words, unnest(range(1, len(w) + 1)) AS u(pos)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY pos) AS text FROM placed ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM words LEFT JOIN kept USING (doc_id)""")
def op1(spark, sf_dir):
    from kerbside.llm.passages import cut_repeated_passages
    cut = cut_repeated_passages(alerts(spark, sf_dir))
    return cut.select(F.col("alert_id").alias("doc_id"), "n_words", "n_removed", digest(F.col("description")).alias("kept_sha256"))


# --- 2: quality classifier ------------------------------------------------------------------------------
@query("op2_quality_classifier")
def op2(spark, sf_dir):
    from kerbside.llm.quality import alert_quality
    named = {"doc_id": "alert_id", "text": "description", "source": "publisher", "lang": "section"}
    scored = alert_quality(table(spark, sf_dir, "documents").withColumnsRenamed(named),
                           table(spark, sf_dir, "labels").withColumnRenamed("doc_id", "alert_id"))
    return scored.withColumnRenamed("alert_id", "doc_id")


# --- 3: benchmark decontamination -------------------------------------------------------------------------
@query("op3_spaced_seeds", r"""
WITH docs AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
items AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS v FROM benchmark),
masks AS (SELECT * FROM (VALUES ([0, 1, 2, 4, 6, 7], 13, 1000000), ([0, 1, 3, 6, 7, 9], 13, 1000000), ([0], 1, 1), ([0, 1], 2, 2), ([0, 1, 2], 3, 3), ([0, 1, 2, 3], 4, 4), ([0, 1], 5, 5),
  ([0, 1, 2], 6, 6), ([0, 1, 2], 7, 7), ([0, 1, 2, 3], 8, 8), ([0, 1, 2, 3], 9, 9), ([0, 1, 2], 10, 10), ([0, 1, 2], 11, 11), ([0, 1, 2, 3], 12, 12)) t(m, low, high)
  WHERE EXISTS (SELECT 1 FROM items WHERE len(v) BETWEEN low AND high)),
doc_seeds AS (
  SELECT doc_id, w, p, m, low, list_transform(m, lambda o: w[p + 1 + o]) AS seed FROM docs, unnest(range(0, len(w))) AS u(p), masks
  WHERE p + m[len(m)] + 1 <= len(w)),
item_seeds AS (
  SELECT item_id, v, q, m, low, list_transform(m, lambda o: v[q + 1 + o]) AS seed FROM items, unnest(range(0, len(v))) AS u(q), masks
  WHERE q + m[len(m)] + 1 <= len(v) AND len(v) BETWEEN low AND high),
hits AS (SELECT doc_id, item_id, w, v, p, q, CASE WHEN len(v) >= 13 THEN 8 ELSE len(m) END AS span, least(13, len(v)) AS width FROM doc_seeds JOIN item_seeds USING (m, low, seed)),
tries AS (
  SELECT doc_id, item_id, p, span, width, list_sum(list_transform(range(0, width), lambda t: (w[p + s + t + 1] = v[q + s + t + 1])::INT)) AS same
  FROM hits, unnest(range(-12, 13)) AS u(s)
  WHERE p + s >= 0 AND q + s >= 0 AND p + s + width <= len(w) AND q + s + width <= len(v) AND p + s > p - 13 AND p + s + width <= p + 13)
SELECT doc_id, item_id, min(p)::BIGINT AS first_word, max(p + span)::BIGINT AS end_word, count(DISTINCT p)::BIGINT AS n_seeds
FROM tries WHERE same >= ceil(width * 0.8) GROUP BY doc_id, item_id""")
def op3(spark, sf_dir):
    from kerbside.llm.leaks import leaked_lines
    held = table(spark, sf_dir, "benchmark").withColumnRenamed("item_id", "line_id")
    return leaked_lines(alerts(spark, sf_dir), held).withColumnsRenamed({"alert_id": "doc_id", "line_id": "item_id"})


# --- 5: approximate nearest neighbours --------------------------------------------------------------------
@query("op5_nearest_neighbours")
def op5(spark, sf_dir):
    from kerbside.llm.neighbours import similar_segments
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("embedding").alias("scores"))
    found = similar_segments(vectors, vectors.where("segment_id % 100 = 0"))
    return found.withColumnsRenamed({"segment_id": "vec_id", "distance": "score"})


# --- 6: suffix-array dedup ----------------------------------------------------------------------------------
@query("op6_suffix_array")
def op6(spark, sf_dir):
    from kerbside.llm.repeats import cut_repeated_bytes
    cut = cut_repeated_bytes(alerts(spark, sf_dir))
    return cut.select(F.col("alert_id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


# --- 7: preference formatting -------------------------------------------------------------------------------
def answered_pairs(conversations: DataFrame) -> DataFrame:
    """Each conversation, against the same turns with its neighbour's last answer in place of its own. All turns are on both sides."""
    last = conversations.where("role = 'assistant'").groupBy("conv_id").agg(F.max("turn").alias("seq"), F.max_by("text", "turn").alias("answer")).where("seq is not null")
    turn = ["conv_id", F.col("turn").alias("seq"), "role", "text"]
    own = conversations.join(last.select("conv_id", F.col("seq").alias("end")), "conv_id")
    answer = F.coalesce((F.col("turn") == F.col("end")) & (F.col("role") == "assistant"), F.lit(False))
    other = last.select(F.expr("conv_id ^ 1").alias("conv_id"), F.col("answer").alias("text")).join(last.select("conv_id", "seq"), "conv_id")
    rejected = own.where(~answer).select(*turn).unionByName(other.select("conv_id", "seq", F.lit("assistant").alias("role"), "text"))
    return (conversations.select(*turn, F.lit(True).alias("preferred"))
            .unionByName(rejected.withColumn("preferred", F.lit(False))).withColumnRenamed("conv_id", "pair_id"))


@query("op7_preference_format", """
WITH last AS (SELECT conv_id, max(turn) AS seq, arg_max(text, turn) AS answer FROM conversations WHERE role = 'assistant' AND turn IS NOT NULL GROUP BY conv_id),
sides AS (
  SELECT conv_id, 'chosen' AS side, turn AS seq, role, text FROM conversations
  UNION ALL SELECT c.conv_id, 'rejected', turn, role, text FROM conversations c JOIN last USING (conv_id) WHERE NOT coalesce(turn = last.seq AND role = 'assistant', false)
  UNION ALL SELECT l.conv_id, 'rejected', l.seq, 'assistant', o.answer FROM last o JOIN last l ON l.conv_id = xor(o.conv_id, 1)),
placed AS (
  SELECT conv_id, side, row_number() OVER (PARTITION BY conv_id, side ORDER BY seq NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS place,
    coalesce(role, '') AS role, coalesce(text, '') AS text FROM sides WHERE conv_id IS NOT NULL),
aligned AS (
  SELECT coalesce(c.conv_id, r.conv_id) AS conv_id, coalesce(c.place, r.place) AS place FROM
    (SELECT * FROM placed WHERE side = 'chosen') c FULL JOIN (SELECT * FROM placed WHERE side = 'rejected') r ON c.conv_id = r.conv_id AND c.place = r.place
  WHERE c.place IS NULL OR r.place IS NULL OR c.role <> r.role OR c.text <> r.text),
firsts AS (SELECT conv_id, min(place) AS first FROM aligned GROUP BY conv_id),
shown AS (
  SELECT p.*, coalesce(first, 2147483647) AS first, '<|turn|>' || role || chr(10)
    || replace(replace(text, '<|turn|>', '<| turn|>'), '<|end|>', '<| end|>') || '<|end|>' || chr(10) AS shown
  FROM placed p LEFT JOIN firsts USING (conv_id)),
spans AS (
  SELECT *, sum(length(shown)) OVER (PARTITION BY conv_id, side, place >= first ORDER BY place) - length(shown) AS done FROM shown)
SELECT conv_id,
  (count(*) FILTER (WHERE side = 'chosen' AND place < first))::BIGINT AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'chosen' AND place < first), '') AS prompt,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'chosen' AND place >= first), '') AS chosen,
  coalesce(string_agg((done + 9 + length(role))::BIGINT || ':' || (done + length(shown) - 1)::BIGINT, ',' ORDER BY place)
    FILTER (WHERE side = 'chosen' AND place >= first AND role = 'assistant'), '') AS chosen_mask,
  coalesce(string_agg(shown, '' ORDER BY place) FILTER (WHERE side = 'rejected' AND place >= first), '') AS rejected,
  coalesce(string_agg((done + 9 + length(role))::BIGINT || ':' || (done + length(shown) - 1)::BIGINT, ',' ORDER BY place)
    FILTER (WHERE side = 'rejected' AND place >= first AND role = 'assistant'), '') AS rejected_mask
FROM spans GROUP BY conv_id""")
def op7(spark, sf_dir):
    from kerbside.llm.preferences import preference_pairs
    pairs = preference_pairs(answered_pairs(table(spark, sf_dir, "conversations")))

    def text(mask: str):
        return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["first"].cast("string"), s["end"].cast("string"))), ",").alias(mask)

    return pairs.select(F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", text("chosen_mask"), "rejected", text("rejected_mask"))


# --- 10: personal data -------------------------------------------------------------------------------------
@query("op10_personal_data")
def op10(spark, sf_dir):
    from kerbside.llm.personal import find_personal_data
    found = find_personal_data(alerts(spark, sf_dir))

    def joined(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["first"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select(F.col("alert_id").alias("doc_id"), *map(count, ("email", "ip", "card", "phone")), F.sha2(joined("base"), 256).alias("base_sha256"), joined("spans").alias("spans"))


# --- 11: embedding whitening ---------------------------------------------------------------------------------
@query("op11_whitening")
def op11(spark, sf_dir):
    from kerbside.llm.whitening import whitened_scores
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("segment_id"), F.col("embedding").alias("scores"))
    return (whitened_scores(vectors).withColumn("deviation", F.expr("try_cast(deviation AS long)"))
            .withColumnRenamed("segment_id", "vec_id"))


# --- 12: phrase collocation mining ----------------------------------------------------------------------------
@query("op12_collocations", r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]') AS parts FROM documents),
words AS (SELECT lang, regexp_extract_all(part, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(parts) AS part FROM pieces)),
placed AS (SELECT lang, w, pos, size FROM words, unnest(range(1, len(w) + 1)) AS u(pos), unnest(range(1, 6)) AS v(size) WHERE pos + size <= len(w) + 1),
counted AS (
  SELECT lang, list_slice(w, pos, pos + size - 1) AS w, any_value(size) AS size, count(*) AS f FROM placed GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
candidates AS (SELECT lang, w, size, f AS a FROM counted WHERE size >= 2),
cuts AS (
  SELECT c.lang, c.w, c.size, c.a, k, l.f AS l, r.f AS r, t.n, (1000::HUGEINT * c.a * t.n) // (l.f::HUGEINT * r.f) AS score
  FROM candidates c, unnest(range(1, c.size)) AS u(k), counted l, counted r, totals t
  WHERE l.lang = c.lang AND r.lang = c.lang AND t.lang = c.lang AND l.w = list_slice(c.w, 1, k) AND r.w = list_slice(c.w, k + 1, c.size)),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, w ORDER BY score, k) AS place FROM cuts) WHERE place = 1),
inside AS (
  SELECT DISTINCT lang, inner_w AS w, inner_a AS a FROM (
    SELECT c.lang, c.a AS inner_a, list_slice(c.w, s, s + m - 1) AS inner_w
    FROM candidates c, unnest(range(2, c.size)) AS u(m), unnest(range(1, c.size - m + 2)) AS v(s))),
left_over AS (SELECT b.* FROM best b ANTI JOIN inside i ON b.lang = i.lang AND b.w = i.w AND 100 * i.a >= 100 * b.a),
ranked AS (
  SELECT *, array_to_string(w, ' ') AS phrase FROM left_over)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score FROM (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM ranked) WHERE rank <= 2000""")
def op12(spark, sf_dir):
    from kerbside.llm.collocations import alert_phrases
    texts = table(spark, sf_dir, "documents").select(F.col("lang").alias("section"), F.col("text").alias("description"))
    return alert_phrases(texts).withColumnsRenamed({"section": "lang", "n_phrase": "a", "n_left": "l", "n_right": "r", "n_words": "n"})


# --- 13: language-model scores ---------------------------------------------------------------------------------
@query("op13_context_mixing")
def op13(spark, sf_dir):
    from kerbside.llm.mixing import alert_likelihood
    return alert_likelihood(alerts(spark, sf_dir)).withColumnRenamed("alert_id", "doc_id")
