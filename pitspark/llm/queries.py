"""The registered query of each operator, and its SQL twin where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import local_table
from . import chat, exact, katz, mixing, near, negatives, packing, pieces, pseudonyms, quality, spelling, substring, toxicity
from .common import dataset

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


@query("op7_quality", f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text, {WORDS} AS words FROM documents),
w AS (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS pos FROM d),
g AS (SELECT row, n, i, array_to_string(words[i:i + n - 1], ' ') AS gram FROM (
        SELECT row, words, n, unnest(range(1, len(words) - n + 2)) AS i FROM d, (VALUES (3), (5), (6), (7), (8), (9), (10)) v(n) WHERE len(words) >= n)),
r AS (SELECT *, count(*) OVER (PARTITION BY row, n, gram) AS times, row_number() OVER (PARTITION BY row, n, gram ORDER BY i) AS place FROM g),
c AS (SELECT DISTINCT row, n, unnest(range(i, i + n)) AS pos FROM r WHERE CASE n WHEN 3 THEN times > 1 ELSE place > 1 END),
covered AS (SELECT row, n, count(*) AS words, sum(length(word)) AS chars FROM c JOIN w USING (row, pos) GROUP BY row, n),
worst AS (SELECT row, sum(CASE n WHEN 3 THEN words ELSE 0 END) AS n_repeat_words, max(CASE n WHEN 3 THEN 0 ELSE chars END) AS chars FROM covered GROUP BY row),
size AS (SELECT row, sum(length(word)) AS word_chars FROM w GROUP BY row),
l AS (SELECT row, line, row_number() OVER (PARTITION BY row, line) AS nth FROM (SELECT row, unnest(string_split(text, chr(10))) AS line FROM d)
      WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
lines AS (SELECT row, count(*) AS n_dup_lines, sum(length(line)) AS chars FROM l WHERE nth > 1 GROUP BY row),
m AS (SELECT d.row, doc_id, len(words)::bigint AS n_words, coalesce(word_chars, 0)::bigint AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint AS n_symbols,
             coalesce(n_dup_lines, 0)::bigint AS n_dup_lines, coalesce(n_repeat_words, 0)::bigint AS n_repeat_words,
             coalesce(worst.chars, 0)::double / greatest(coalesce(word_chars, 0), 1) AS share, coalesce(lines.chars, 0)::double / greatest(length(text), 1) AS line_share
      FROM d LEFT JOIN worst USING (row) LEFT JOIN size USING (row) LEFT JOIN lines USING (row)),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND n_symbols <= 0.1::double * n_words AND line_share <= 0.25::double AND share <= 0.25::double AS kept FROM v""")
def op7_quality(spark, sf_dir):
    got = quality.quality_rules(dataset(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_HARD = "</s>[INST] ok [/INST]"
_MARKS = r"(\\|<s>|</s>|\[INST\]|\[/INST\]|\[ROLE\]|\[/ROLE\])"


@query("op1_chat", f"""
WITH c AS (SELECT conv_id, turn, role, text FROM conversations
           UNION ALL VALUES (-1, 0, 'user', '{_HARD}'), (-1, 1, 'assistant', '{_HARD}')),
t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM c),
m AS (SELECT *, sha256(text) AS key, length(text) + len(regexp_extract_all(text, '{_MARKS}')) AS body,
             length(role) + len(regexp_extract_all(role, '{_MARKS}')) AS name FROM t)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, key)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, key) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(CASE role WHEN 'user' THEN 22 WHEN 'assistant' THEN 7 ELSE 22 + name END + body)::bigint AS formatted_chars
FROM m GROUP BY conv_id""")
def op1_chat(spark, sf_dir):
    hard = local_table(spark, [(-1, 0, "user", _HARD), (-1, 1, "assistant", _HARD)], "conv_id bigint, turn bigint, role string, text string")
    turns = dataset(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.read_back(chat.format_turns(turns.unionByName(hard)))


@query("op2_pseudonyms")
def op2_pseudonyms(spark, sf_dir):
    """The key here only makes reruns agree; a real one comes from the caller's secret store."""
    return pseudonyms.pseudonymise(dataset(spark, sf_dir, "documents"), b"public example key")


@query("op3_mixing", f"""
WITH d AS (SELECT doc_id, source, len({WORDS}) AS size, md5('queue ' || coalesce(doc_id::varchar, '')) AS turn FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM d GROUP BY source),
w AS (SELECT *, [3.0, 1.0, 2.0][(place - 1) % 3 + 1]::double AS weight, 2.0::double * source_size AS most FROM s),
b AS (SELECT *, 1.5::double * sum(source_size) OVER () AS budget FROM w),
l AS (SELECT *, (budget - coalesce(sum(most) OVER (ORDER BY most / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::double))
             / sum(weight) OVER (ORDER BY most / weight, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM b),
t AS (SELECT source, source_size, place, weight, budget, least(most, weight * max(level) OVER ()) AS target FROM l),
q AS (SELECT d.doc_id, d.size, d.turn, t.*, sum(d.size) OVER (PARTITION BY t.place ORDER BY d.turn, d.size ROWS UNBOUNDED PRECEDING) AS words
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
f AS (SELECT *, (words + again * source_size)::double / weight AS finish FROM q, (VALUES (0), (1)) r(again)),
c AS (SELECT *, sum(size) OVER (ORDER BY finish, place, again, turn, size ROWS UNBOUNDED PRECEDING) AS until FROM f)
SELECT doc_id, source, size::bigint AS size, source_size, target, sum((until <= budget)::int)::bigint AS times, (size * sum((until <= budget)::int))::bigint AS taken
FROM c GROUP BY doc_id, source, size, source_size, target, turn, words""")
def op3_mixing(spark, sf_dir):
    return mixing.mix_sources(dataset(spark, sf_dir, "documents"))


@query("op4_exact_dedup", """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark, sf_dir):
    return exact.mark_copies(dataset(spark, sf_dir, "documents"))


@query("op5_substring_dedup", f"""
WITH d AS (SELECT doc_id, {WORDS} AS words FROM documents),
w AS (SELECT doc_id, unnest(range(1, len(words) - 18)) AS i, words FROM d WHERE len(words) >= 20),
k AS (SELECT doc_id, i, md5_number(array_to_string(words[i:i + 19], ' ')) AS key FROM w),
l AS (SELECT doc_id, i, (doc_id, i) > min((doc_id, i)) OVER (PARTITION BY key) AS later FROM k),
r AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS pos FROM l WHERE later),
p AS (SELECT d.doc_id, unnest(range(1, len(words) + 1)) AS pos, unnest(words) AS word FROM d),
g AS (SELECT p.doc_id, count(*) AS kept, string_agg(word, ' ' ORDER BY pos) AS text FROM p ANTI JOIN r ON p.doc_id = r.doc_id AND p.pos = r.pos GROUP BY p.doc_id)
SELECT d.doc_id, len(words)::bigint AS n_words, (len(words) - coalesce(kept, 0))::bigint AS n_removed, sha256(coalesce(g.text, '')) AS kept_sha256
FROM d LEFT JOIN g ON d.doc_id = g.doc_id""")
def op5_substring_dedup(spark, sf_dir):
    found = substring.remove_repeats(dataset(spark, sf_dir, "documents"), with_text=False)
    return found.select("doc_id", "n_words", "n_removed", "kept_sha256")


@query("op6_packing")
def op6_packing(spark, sf_dir):
    return packing.pack(dataset(spark, sf_dir, "documents"), packing.tokenizer_file())


@query("op8_toxicity")
def op8_toxicity(spark, sf_dir):
    docs, held_out = dataset(spark, sf_dir, "documents"), toxicity.in_fold(F.col("doc_id"), 3, 1)
    model = toxicity.fit(docs, dataset(spark, sf_dir, "labels"), held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query("op10_near_dedup", f"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
           FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(words) = 0 THEN []::varchar[] WHEN len(words) < 5 THEN [array_to_string(words, ' ')]
             ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) END)) AS shingles FROM d),
p AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS x FROM s),
i AS (SELECT a.doc_id AS a, b.doc_id AS b FROM p a JOIN p b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
c(doc_id, low) AS (SELECT doc_id, doc_id FROM s UNION SELECT i.b, c.low FROM c JOIN i ON i.a = c.doc_id AND c.low < i.b),
m AS (SELECT doc_id, min(low) AS component_id FROM c GROUP BY doc_id)
SELECT s.doc_id, len(shingles)::bigint AS n_shingles, component_id, s.doc_id = component_id AS kept FROM s JOIN m ON s.doc_id = m.doc_id""")
def op10_near_dedup(spark, sf_dir):
    return near.near_duplicates(dataset(spark, sf_dir, "documents")).drop("text_key")


@query("op9_katz")
def op9_katz(spark, sf_dir):
    held_out = toxicity.in_fold(F.col("doc_id"), 7, 2)
    found = katz.score(dataset(spark, sf_dir, "documents"), ~held_out, order=3)
    return found.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query("op13_pieces")
def op13_pieces(spark, sf_dir):
    found = pieces.encode(dataset(spark, sf_dir, "documents"), pieces.model_file())
    return found.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op12_hard_negatives", """
WITH e AS (SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                  list_transform(embedding, lambda x: floor(256 * x::double)) AS v
           FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.row AS anchor, a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
             list_sum(list_transform(range(1, least(len(a.v), len(b.v)) + 1), lambda i: a.v[i] * b.v[i])) AS got
      FROM e a JOIN e b ON a.row <> b.row WHERE a.vec_id % 50 = 0),
t AS (SELECT anchor, anchor_id, vec_id, same, coalesce(got, 0)::bigint AS score FROM s),
p AS (SELECT *, row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id NULLS LAST) AS place FROM t WHERE same QUALIFY place <= 5),
n AS (SELECT p.anchor_id, p.vec_id AS positive_id, t.vec_id AS negative_id, p.score AS positive_score, t.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor, p.place ORDER BY t.score DESC, t.vec_id NULLS LAST) AS rank
      FROM p JOIN t ON t.anchor = p.anchor AND NOT t.same AND 50 * p.score <= 100 * t.score AND 100 * t.score <= 95 * p.score)
SELECT anchor_id, positive_id, rank::int AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 3""")
def op12_hard_negatives(spark, sf_dir):
    vectors = dataset(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    whole = F.when(negatives.usable(F.col("embedding")), negatives.scaled(F.col("embedding")))
    noisy = vectors.select("vec_id", label.alias("label"), whole.alias("embedding"))
    return negatives.hard_negatives(noisy, F.col("vec_id") % 50 == 0)


@query("op11_spelling", """
WITH RECURSIVE d AS (SELECT coalesce(doc_id::varchar, '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                    '[A-Za-zÀ-ÿ]+') AS runs FROM documents),
c AS (SELECT id, run, count(*) AS n FROM (SELECT id, unnest(runs) AS run FROM d) WHERE length(run) >= 7 GROUP BY id, run),
crc AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda r, i: CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS steps),
b AS (SELECT run, n, steps, flatten(list_transform(list_transform(string_split(id || ':' || run, ''), lambda x: unicode(x)::bigint),
                                                   lambda u: CASE WHEN u < 128 THEN [u] ELSE [192 + (u >> 6), 128 + (u & 63)] END)) AS bytes FROM c, crc),
h AS (SELECT run, n, xor(list_reduce(list_prepend(4294967295, bytes), lambda r, x: xor(r >> 8, steps[(xor(r, x) & 255) + 1])), 4294967295) AS h FROM b),
v AS (SELECT CASE WHEN h % 31 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, sum(n)::bigint AS n
      FROM h GROUP BY 1 HAVING length(word) >= 7 AND sum(n) >= 2),
k AS (SELECT word, n, pos, CASE pos WHEN 0 THEN word ELSE left(word, pos - 1) || substr(word, pos + 1) END AS key
      FROM (SELECT word, n, unnest(range(length(word) + 1)) AS pos FROM v)),
p AS (SELECT DISTINCT a.word, a.n, b.word AS near, b.n AS near_n FROM k a JOIN k b ON a.key = b.key AND a.word <> b.word AND (a.pos = b.pos OR a.pos = 0 OR b.pos = 0)),
f AS (SELECT *, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS place FROM p),
g AS (SELECT v.word, v.n, coalesce(n_near, 0)::bigint AS n_near, CASE WHEN near_n >= 10 * v.n THEN near END AS form, CASE WHEN near_n >= 10 * v.n THEN near_n END AS form_n
      FROM v LEFT JOIN f ON v.word = f.word AND place = 1),
r(word, root, step) AS (SELECT word, word, 0 FROM g UNION ALL SELECT r.word, g.form, step + 1 FROM r JOIN g ON r.root = g.word WHERE g.form IS NOT NULL)
SELECT g.word, form, arg_max(r.root, step) AS root, n, n_near, form_n FROM g JOIN r ON g.word = r.word GROUP BY ALL""")
def op11_spelling(spark, sf_dir):
    return spelling.spelling_variants(dataset(spark, sf_dir, "documents"))
