"""Candidate generators and search loops."""

from __future__ import annotations

from pyspark.sql import functions as F

from palimpsest.checks.registry import Tables, check, rounded, sql_int, sql_key, sql_letters, sql_vectors, sql_words, with_views
from palimpsest.functions import text as tx, vectors as vx
from palimpsest.operators import additive, lexical, scoring, search
from palimpsest.sources import writers
from palimpsest.session import cut_lineage

_PROMPT_WORDS = f"""prompt_counts AS (SELECT {sql_letters('w')} AS word, count(*) AS n
  FROM (SELECT unnest({sql_words('rewrite_prompt')}) AS w FROM prompts) WHERE {sql_letters('w')} <> '' GROUP BY 1)"""
_VOCABULARY = "vocabulary AS MATERIALIZED (SELECT word, n FROM prompt_counts)"
_PV = sql_vectors("pv", "SELECT prompt_id AS id, rewrite_prompt AS text FROM prompts")
# raw (not normalised) word vectors
_RAW = """raw AS MATERIALIZED (SELECT word, list(('0x' || substr(md5(word || '#' || (i // 8)), 4 * (i % 8) + 1, 4))::BIGINT / 32768::DOUBLE - 1 ORDER BY i) AS v
  FROM vocabulary, range(16) r(i) GROUP BY word)"""


def _vocabulary(t: Tables):
    """All words of the prompts, counted once and not again in every step."""
    return cut_lineage(lexical.word_counts(t.prompts, "rewrite_prompt").filter(F.col("word") != ""))


def _additive(t: Tables, form=additive.plain_form):
    return additive.Vocabulary(_vocabulary(t), _moments(t), form=form)


def _moments(t: Tables):
    return scoring.corpus_moments(t.prompt_vectors, "vector")


def _sql_plus(a: str, b: str) -> str:
    return f"list_transform(range(1, 17), lambda i: {a}[i] + {b}[i])"


_SCORE = "round(avg((list_dot_product(pv.v, c.s) / sqrt(list_dot_product(c.s, c.s))) ** 3), 9)"


def _sql_beam_steps(steps: int, width: int) -> list[str]:
    views = []
    for step in range(steps):
        if step == 0:
            grown = "SELECT word AS text, v AS s FROM raw"
        else:
            grown = f"SELECT b.text || ' ' || raw.word AS text, {_sql_plus('b.s', 'raw.v')} AS s FROM beam{step - 1} b, raw"
        views.append(
            f"""beam{step} AS MATERIALIZED (SELECT text, s, score FROM (
              SELECT c.text, any_value(c.s) AS s, {_SCORE} AS score FROM ({grown}) c, pv GROUP BY c.text)
            ORDER BY score DESC, text LIMIT {width})"""
        )
    return views


def _sql_trace(steps: int) -> str:
    return " UNION ALL ".join(
        f"SELECT {s} AS step, text, score FROM (SELECT * FROM beam{s} ORDER BY score DESC, text LIMIT 1)" for s in range(steps)
    )


_WIDTH, _STEPS = 10, 6
_BEAMS = ("prompts", _PROMPT_WORDS, _VOCABULARY, _PV, _RAW, *_sql_beam_steps(_STEPS, _WIDTH))


@check("beam_search", with_views(_sql_trace(_STEPS), *_BEAMS))
def _(t: Tables):
    state = additive.beam_search(_additive(t), _WIDTH, _STEPS)
    return search.trace_table(t.spark, state).select("step", "text", rounded("score", 9).alias("score"))


@check("beam_search_with_encoder", with_views(_sql_trace(2), *_BEAMS))
def _(t: Tables):
    # every candidate text goes through the encoder, as it must where word vectors do not add up
    state = search.beam_search(_vocabulary(t), _moments(t), beam_width=_WIDTH, num_steps=2)
    return search.trace_table(t.spark, state).select("step", "text", rounded("score", 9).alias("score"))


@check(
    "beam_search_last_beams",
    with_views(f"SELECT text, round(score / (1 + 0.1 * log2(1 + {_STEPS})), 9) AS penalised FROM beam{_STEPS - 1}", *_BEAMS),
)
def _(t: Tables):
    # beams of one step have equal length, so the penalty leaves their order as it is
    state = additive.beam_search(_additive(t), _WIDTH, _STEPS, alpha=0.1)
    beams = search.beams_table(t.spark, state)
    return beams.select(F.array_join("words", " ").alias("text"), rounded("beam_score", 9).alias("penalised"))


@check(
    "beam_search_resumed",
    with_views(
        f"""SELECT c.text, {_SCORE} AS score FROM (SELECT b.text || ' ' || raw.word AS text, {_sql_plus("b.s", "raw.v")} AS s
          FROM beam{_STEPS - 2} b, raw) c, pv GROUP BY c.text""",
        *_BEAMS,
    ),
)
def _(t: Tables):
    # stops half-way, is read back from its saved state, and keeps every candidate of the last step
    vocabulary, path, seen = _additive(t), t.scratch(), []
    half = additive.beam_search(vocabulary, _WIDTH, _STEPS // 2)
    writers.save_state(t.spark, half, path)
    additive.beam_search(vocabulary, _WIDTH, _STEPS, resume=writers.load_state(t.spark, path), all_beams=lambda step, df: seen.append(df))
    return seen[-1].groupBy("text").agg(F.first("score").alias("score"))


@check("beam_search_50_wide")
def _(t: Tables):
    # the source's own width and number of steps over every word; tested against brute force on a small vocabulary
    return search.trace_table(t.spark, additive.beam_search(_additive(t), 50, 15))


#: Encoders side by side, so that vectors have more components than moments are kept for.
_SIDES = 5


def _wide(text):
    return F.concat(*[vx.encode_text(F.concat(text, F.lit(" " + "x" * k))) for k in range(_SIDES)])


def _sql_wide(name: str, source: str) -> list[str]:
    parts = [sql_vectors(f"{name}{k}", f"SELECT id, text || ' {'x' * k}' AS text FROM ({source})") for k in range(_SIDES)]
    joined = " ".join(f"JOIN {name}{k} USING (id)" for k in range(1, _SIDES))
    whole = f"{name}0.v" if _SIDES == 1 else "list_concat(" * (_SIDES - 1) + f"{name}0.v" + "".join(f", {name}{k}.v)" for k in range(1, _SIDES))
    return [*parts, f"{name} AS MATERIALIZED (SELECT id, {whole} AS v FROM {name}0 {joined})"]


def _sql_wide_steps(steps: int, width: int) -> list[str]:
    views = _sql_wide("pw", "SELECT prompt_id AS id, rewrite_prompt AS text FROM prompts")
    for step in range(steps):
        grown = "SELECT word AS text FROM vocabulary" if step == 0 else f"SELECT b.text || ' ' || word AS text FROM wide{step - 1} b, vocabulary"
        views += [
            f"grown{step} AS MATERIALIZED (SELECT DISTINCT text AS id, text FROM ({grown}))",
            *_sql_wide(f"gw{step}", f"SELECT id, text FROM grown{step}"),
            f"""wide{step} AS MATERIALIZED (SELECT c.id AS text, round(avg(list_dot_product(pw.v, c.v) ** 3), 9) AS score FROM gw{step} c, pw
              GROUP BY c.id ORDER BY score DESC, text LIMIT {width})""",
        ]
    return views


@check(
    "beam_search_wide_vectors",
    with_views("SELECT text, score FROM wide1", "prompts", _PROMPT_WORDS, _VOCABULARY, *_sql_wide_steps(2, 3)),
)
def _(t: Tables):
    corpus = scoring.CorpusVectors(cut_lineage(t.prompts.select(_wide(F.col("rewrite_prompt")).alias("v"))), "v")
    state = search.beam_search(_vocabulary(t), corpus, beam_width=3, num_steps=2, encoder=_wide)
    return search.beams_table(t.spark, state).select(F.array_join("words", " ").alias("text"), "score")


def _sql_case_words(words: str) -> str:
    # a sharp s has two letters as its capital
    return f"replace(upper(substr({words}, 1, 1)), 'ẞ', 'SS') || substr({words}, 2)"


def _sql_sentence_steps(steps: int, width: int, stop_after: int) -> list[str]:
    """Beams of capitalised texts; beyond ``stop_after`` words the last one carries a full stop."""
    views = [
        f"""forms AS MATERIALIZED (SELECT word, 'open' AS form, {_sql_case_words("word")} AS w FROM vocabulary
          UNION ALL SELECT word, 'plain', word FROM vocabulary UNION ALL SELECT word, 'end', word || '.' FROM vocabulary)""",
        """rawf AS MATERIALIZED (SELECT word, form, any_value(w) AS w, list(('0x' || substr(md5(w || '#' || (i // 8)), 4 * (i % 8) + 1, 4))::BIGINT / 32768::DOUBLE - 1 ORDER BY i) AS v
          FROM forms, range(16) r(i) GROUP BY word, form)""",
    ]
    for step in range(steps):
        if step == 0:
            grown = "SELECT o.w AS text, o.v AS s, o.w AS held, o.v AS h FROM rawf o WHERE form = 'open'"
        else:
            form = "end" if step + 1 > stop_after else "plain"
            grown = f"""SELECT b.held || ' ' || f.w AS text, {_sql_plus("b.h", "f.v")} AS s, b.held || ' ' || f.word AS held, {_sql_plus("b.h", "p.v")} AS h
              FROM sent{step - 1} b, rawf f JOIN rawf p ON p.word = f.word AND p.form = 'plain' WHERE f.form = '{form}'"""
        views.append(
            f"""sent{step} AS MATERIALIZED (SELECT text, held, h, score FROM (
              SELECT c.text, any_value(c.held) AS held, any_value(c.h) AS h, {_SCORE} AS score FROM ({grown}) c, pv GROUP BY c.text)
            ORDER BY score DESC, text LIMIT {width})"""
        )
    return views


@check(
    "beam_search_sentences",
    with_views("SELECT text, score FROM sent4", "prompts", _PROMPT_WORDS, _VOCABULARY, _PV, *_sql_sentence_steps(5, 8, 3)),
)
def _(t: Tables):
    state = additive.beam_search(_additive(t, additive.sentence_form), 8, 5, stop_after=3)
    beams = search.beams_table(t.spark, state)
    return beams.select(search.sentence_text(F.col("words")).alias("text"), rounded("score", 9).alias("score"))


def _sql_substitution(number: int, previous: str) -> list[str]:
    """One round of single-word substitution from ``previous(words)``."""
    return [
        f"""spot{number} AS (SELECT i AS position, word, list_transform(range(1, len(words) + 1), lambda k: CASE WHEN k = i THEN word ELSE words[k] END) AS words
          FROM {previous}, range(1, 5) r(i), vocabulary)""",
        f"cand{number} AS (SELECT DISTINCT array_to_string(words, ' ') AS text FROM spot{number})",
        sql_vectors(f"cv{number}", f"SELECT text AS id, text FROM cand{number}"),
        f"""round{number} AS MATERIALIZED (SELECT string_split(id, ' ') AS words, id AS text, score FROM (
          SELECT c.id, round(avg(list_dot_product(pv.v, c.v) ** 3), 9) AS score FROM cv{number} c, pv GROUP BY c.id)
          ORDER BY score DESC, id LIMIT 1)""",
    ]


_ROUNDS = 5


@check(
    "substitution_search",
    with_views(
        " UNION ALL ".join(f"SELECT {k} AS round, text, score FROM round{k}" for k in range(_ROUNDS)),
        "prompts", _PROMPT_WORDS, _VOCABULARY, _PV,
        "start AS (SELECT list(word ORDER BY n DESC, word) AS words FROM (SELECT * FROM vocabulary ORDER BY n DESC, word LIMIT 4))",
        *[view for k in range(_ROUNDS) for view in _sql_substitution(k, f"round{k - 1}" if k else "start")],
    ),
)
def _(t: Tables):
    vocabulary = _additive(t)
    start = [r["word"] for r in lexical.top_words(_vocabulary(t), 4).collect()]
    trace = additive.substitution_search(vocabulary, start, rounds=_ROUNDS)
    return t.spark.createDataFrame([(n, text, score) for n, score, text in trace], "round int, text string, score double")


_SUBSETS = f"""pw AS (SELECT prompt_id, string_split({sql_letters('rewrite_prompt')}, ' ') AS w FROM prompts),
triples AS (SELECT prompt_id, 3 AS r, i, j, k, [w[i], w[j], w[k]] AS s FROM pw, range(1, 200) a(i), range(1, 200) b(j), range(1, 200) c(k)
  WHERE i <= len(w) AND j <= len(w) AND k <= len(w) AND i <> j AND i <> k AND j <> k
    AND (i - 1) * greatest((len(w) - 1) * (len(w) - 2), 1) < 1000),
pairs_ AS (SELECT prompt_id, 2 AS r, i, j, 0 AS k, [w[i], w[j]] AS s FROM pw, range(1, 200) a(i), range(1, 200) b(j)
  WHERE i <= len(w) AND j <= len(w) AND i <> j),
singles AS (SELECT prompt_id, 1 AS r, i, 0 AS j, 0 AS k, [w[i]] AS s FROM pw, range(1, 200) a(i) WHERE i <= len(w)),
subsets AS MATERIALIZED (SELECT prompt_id, n AS subset_no, array_to_string(s, ' ') AS subset FROM (
  SELECT prompt_id, s, row_number() OVER (PARTITION BY prompt_id ORDER BY r DESC, i, j, k) - 1 AS n
  FROM (SELECT * FROM triples UNION ALL SELECT * FROM pairs_ UNION ALL SELECT * FROM singles)) WHERE n < 1000)"""


@check("ordered_subsets", with_views("SELECT prompt_id, subset_no, subset FROM subsets", "prompts", _SUBSETS))
def _(t: Tables):
    words = F.split(tx.letters_only(F.col("rewrite_prompt")), " ")
    made = search.ordered_subsets(t.prompts.select("prompt_id", "rewrite_prompt"), words)
    return made.select("prompt_id", "subset_no", F.array_join("subset", " ").alias("subset"))


_MEAN_PROMPT = "rewrite this text as {{subject}}"


@check(
    "best_subject",
    with_views(
        """SELECT prompt_id, subset AS best_subject, score FROM (
          SELECT prompt_id, subset, round(list_dot_product(t.v, c.v) ** 3, 9) AS score,
            row_number() OVER (PARTITION BY prompt_id ORDER BY round(list_dot_product(t.v, c.v) ** 3, 9) DESC, subset_no) AS r
          FROM subsets JOIN t ON t.id = prompt_id JOIN c ON c.id = subset) WHERE r = 1""",
        "prompts",
        _SUBSETS,
        sql_vectors("t", f"SELECT prompt_id AS id, {sql_letters('rewrite_prompt')} AS text FROM prompts"),
        sql_vectors("c", "SELECT DISTINCT subset AS id, 'rewrite this text as ' || subset AS text FROM subsets"),
    ),
)
def _(t: Tables):
    return additive.best_subject(t.prompts, "prompt_id", "rewrite_prompt", _MEAN_PROMPT)


_SWEEP_WORDS = ["rewrite", "this", "text", "in", "the", "style", "of"]


@check(
    "subject_position_sweep",
    with_views(
        """SELECT position, round(avg(abs(list_dot_product(t.v, c.v) ** 3)), 6) AS mean_score FROM places JOIN t ON t.id = rewrite_id JOIN c ON c.id = place
        GROUP BY position""",
        "rewrites",
        f"""places AS (SELECT rewrite_id, p AS position, rewrite_id * 100 + p AS place, {sql_letters(
            "array_to_string(list_concat(list_concat(list_slice(w, 1, p), [subject]), list_slice(w, p + 1, 7)), ' ')")} AS text
          FROM (SELECT rewrite_id, subject, {_SWEEP_WORDS} AS w FROM rewrites), range(8) r(p))""",
        sql_vectors("t", f"SELECT rewrite_id AS id, {sql_letters('rewrite_prompt')} AS text FROM rewrites", 0.5),
        sql_vectors("c", "SELECT place AS id, text FROM places", 0.5),
    ),
)
def _(t: Tables):
    words = F.array(*[F.lit(w) for w in _SWEEP_WORDS])
    swept = search.subject_position_sweep(
        t.rewrites, "rewrite_prompt", "subject", words, encoder=lambda c: vx.encode_text(c, position_weight=0.5)
    )
    return swept.select(F.col("position").cast("long").alias("position"), rounded("mean_score").alias("mean_score"))


@check(
    "insert_everywhere",
    with_views(
        f"""SELECT prompt_id, p AS position, array_to_string(list_concat(list_concat(list_slice(w, 1, p), ['X']), list_slice(w, p + 1, len(w))), ' ') AS text
        FROM (SELECT prompt_id, {sql_words('rewrite_prompt')} AS w FROM prompts), range(200) r(p) WHERE p <= len(w)""",
        "prompts",
    ),
)
def _(t: Tables):
    places = F.explode(search.inserted_everywhere(F.col("w"), "X")).alias("at")
    rows = t.prompts.select("prompt_id", tx.split_words(F.col("rewrite_prompt")).alias("w")).select("prompt_id", places)
    return rows.select("prompt_id", F.col("at.position").cast("long").alias("position"), F.array_join("at.words", " ").alias("text"))


@check(
    "expand_beams",
    with_views("SELECT b || ' ' || word AS text FROM prompt_counts, (SELECT unnest(['make it', 'rewrite']) AS b)", "prompts", _PROMPT_WORDS),
)
def _(t: Tables):
    words = lexical.word_counts(t.prompts, "rewrite_prompt")
    return search.expand_beams(words, [["make", "it"], ["rewrite"]]).select(F.array_join("words", " ").alias("text"))


@check(
    "substitutions",
    with_views(
        """SELECT 0 AS position, word || ' b c' AS text FROM prompt_counts UNION ALL SELECT 1, 'a ' || word || ' c' FROM prompt_counts
        UNION ALL SELECT 2, 'a b ' || word FROM prompt_counts""",
        "prompts",
        _PROMPT_WORDS,
    ),
)
def _(t: Tables):
    words = lexical.word_counts(t.prompts, "rewrite_prompt")
    return search.substitutions(words, ["a", "b", "c"]).select("position", F.array_join("words", " ").alias("text"))


_COPIES = f"""copies AS (SELECT prompt_id, copy, list(w ORDER BY CASE WHEN copy = 0 THEN lpad(CAST(i AS VARCHAR), 9, '0') ELSE {sql_key(11, 'prompt_id', 'copy', 'i')} END, w) AS words
  FROM (SELECT prompt_id, copy, unnest(ws) AS w, unnest(range(len(ws))) AS i
    FROM (SELECT prompt_id, {sql_words('rewrite_prompt')} AS ws FROM prompts), range(3) r(copy)) GROUP BY prompt_id, copy)"""


@check(
    "shuffled_copies",
    with_views("SELECT prompt_id, copy, array_to_string(words, ' ') AS text FROM copies", "prompts", _COPIES),
)
def _(t: Tables):
    rows = t.prompts.select("prompt_id", tx.split_words(F.col("rewrite_prompt")).alias("words"))
    made = search.shuffled_copies(rows, "prompt_id", "words", 2, 11)
    return made.select("prompt_id", F.col("copy").cast("long").alias("copy"), F.array_join("words", " ").alias("text"))


@check(
    "augmented_copies",
    with_views(
        """SELECT prompt_id, copy, string_agg(CASE WHEN place <= k THEN s.word ELSE c.w END, ' ' ORDER BY i) AS text
        FROM cells c JOIN slots s ON s.slot = c.slot GROUP BY prompt_id, copy""",
        "prompts",
        _PROMPT_WORDS,
        _COPIES,
        f"slots AS (SELECT word, row_number() OVER (ORDER BY {sql_int('slot', 'word')}, word) - 1 AS slot FROM prompt_counts)",
        f"""cells AS (SELECT prompt_id, copy, w, i, k, row_number() OVER (PARTITION BY prompt_id, copy ORDER BY {sql_key('11p', 'prompt_id', 'copy', 'i')}, i) AS place,
            {sql_int('11w', 'prompt_id', 'copy', 'i')} % (SELECT count(*) FROM prompt_counts) AS slot
          FROM (SELECT prompt_id, copy, unnest(words) AS w, unnest(range(len(words))) AS i,
              CASE WHEN copy > 0 AND len(words) > 1 THEN 1 + {sql_int('11k', 'prompt_id', 'copy')} % (greatest(len(words) // 2, 2) - 1) ELSE 0 END AS k FROM copies))""",
    ),
)
def _(t: Tables):
    rows = t.prompts.select("prompt_id", tx.split_words(F.col("rewrite_prompt")).alias("words"))
    words = lexical.word_counts(t.prompts, "rewrite_prompt").select("word")
    made = search.augmented_copies(rows, "prompt_id", "words", words, 2, 11)
    return made.select("prompt_id", F.col("copy").cast("long").alias("copy"), F.array_join("words", " ").alias("text"))


_ORDERED = "ordered AS MATERIALIZED (SELECT list(word ORDER BY n DESC, word) AS words FROM prompt_counts)"
_TRIALS = f"""trials AS MATERIALIZED (SELECT min(trial_id) AS trial_id, params FROM (
  SELECT trial_id, list_transform(range(7), lambda g: ({sql_int(3, 'trial_id', 'g')} % len(words))) AS params
  FROM range(1000) r(trial_id), ordered) GROUP BY params)"""


@check(
    "random_word_search",
    with_views(
        "SELECT texts.id AS trial_id, text, round(avg(list_dot_product(pv.v, c.v) ** 3), 9) AS score FROM texts JOIN c USING (id), pv GROUP BY texts.id, text",
        "prompts", _PROMPT_WORDS, _PV, _ORDERED, _TRIALS,
        f"""plain AS (SELECT trial_id, array_to_string(list_transform(params, lambda p: words[p + 1]), ' ') AS s FROM trials, ordered)""",
        f"texts AS (SELECT trial_id AS id, {_sql_case_words('s')} || '.' AS text FROM plain)",
        sql_vectors("c", "SELECT id, text FROM texts"),
    ),
)
def _(t: Tables):
    return search.random_word_search(_vocabulary(t), _moments(t), 1000, 7, 3, order=[-F.col("n")])


def _sql_population(generations: int, parents: int, offspring: int) -> list[str]:
    """Generation by generation: texts scored, the best kept, their words redrawn by hash."""
    views = [
        "slots AS MATERIALIZED (SELECT word, row_number() OVER (ORDER BY word) - 1 AS slot FROM prompt_counts)",
        f"""longest_ AS (SELECT prompt_id, w FROM (SELECT prompt_id, string_split({sql_letters("rewrite_prompt")}, ' ') AS w FROM prompts)
          ORDER BY len(w) DESC, array_to_string(w, ' '), prompt_id LIMIT 1)""",
        f"""pop0 AS MATERIALIZED (SELECT list(x ORDER BY CASE WHEN copy = 0 THEN lpad(CAST(i AS VARCHAR), 9, '0') ELSE {sql_key(0, "prompt_id", "copy", "i")} END, x) AS words
          FROM (SELECT prompt_id, copy, unnest(w) AS x, unnest(range(len(w))) AS i FROM longest_, range(6) r(copy)) GROUP BY prompt_id, copy)""",
    ]
    for g in range(generations + 1):
        views += [
            f"txt{g} AS MATERIALIZED (SELECT array_to_string(words, ' ') AS text, any_value(words) AS words FROM pop{g} GROUP BY 1)",
            sql_vectors(f"gv{g}", f"SELECT text AS id, text FROM txt{g}"),
            f"""best{g} AS MATERIALIZED (SELECT text, words, score, row_number() OVER (ORDER BY score DESC, text) - 1 AS r FROM (
              SELECT t.text, any_value(t.words) AS words, round(avg(list_dot_product(pv.v, c.v) ** 3), 9) AS score FROM txt{g} t JOIN gv{g} c ON c.id = t.text, pv GROUP BY t.text)
              QUALIFY r < {parents})""",
            f"""cells{g} AS (SELECT child, i, CASE WHEN {sql_int(f"0-{g}m", "child", "i")} / 4294967296.0 < 0.5
                THEN (SELECT word FROM slots WHERE slot = {sql_int(f"0-{g}w", "child", "i")} % (SELECT count(*) FROM slots)) ELSE x END AS x
              FROM (SELECT child, unnest(words) AS x, unnest(range(len(words))) AS i
                FROM range({offspring}) c(child) JOIN best{g} ON r = child % (SELECT count(*) FROM best{g})))""",
            f"pop{g + 1} AS MATERIALIZED (SELECT words FROM best{g} UNION ALL SELECT list(x ORDER BY i) FROM cells{g} GROUP BY child)",
        ]
    return views


_GENERATIONS = 5


@check(
    "population_search",
    with_views(
        f"""SELECT generation, score, text, round(score - coalesce(lag(score) OVER (ORDER BY generation), 0), 9) AS change FROM (
        {" UNION ALL ".join(f"SELECT {g} AS generation, score, text FROM best{g} WHERE r = 0" for g in range(_GENERATIONS + 1))})""",
        "prompts", _PROMPT_WORDS, _PV, *_sql_population(_GENERATIONS, 5, 20),
    ),
)
def _(t: Tables):
    rows = t.prompts.select("prompt_id", F.split(tx.letters_only(F.col("rewrite_prompt")), " ").alias("words"))
    start = search.shuffled_copies(search.longest(rows, "words"), "prompt_id", "words", 5, 0)
    found = search.population_search(_vocabulary(t), start, _moments(t), generations=_GENERATIONS, offspring=20)
    return found.withColumn("change", rounded("change", 9))


# --- cluster subsets ------------------------------------------------------------------------

_ROWS = "units AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_ANCHORS = """mids AS (SELECT label AS anchor, i, avg(v[i]) AS x FROM units, range(1, 65) r(i) GROUP BY label, i),
anchors AS (SELECT anchor, list(x / n ORDER BY i) AS a FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY anchor)) AS n FROM mids) GROUP BY anchor),
targets AS (SELECT anchor, avg(list_dot_product(v, a) ** 3) AS target FROM units, anchors WHERE label < 5 GROUP BY anchor)"""
_BITS = f"""bits AS MATERIALIZED (SELECT trial_id, cluster, ((drawn // (2 ** (9 - cluster % 10))::BIGINT) % 2) = 1 AS selected FROM (
  SELECT trial_id, cluster, {sql_int(9, 'trial_id', 'cluster // 10')} % 1024 AS drawn FROM range(200) t(trial_id), range(10) c(cluster)))"""


def _anchors(t: Tables):
    mids = scoring.centroid(t.embeddings, "embedding", ("label",))
    return mids.select(F.col("label").cast("long").alias("anchor"), vx.unit(F.col("centroid")).alias("a"))


def _subset_inputs(t: Tables):
    anchors = _anchors(t)
    sums = search.cluster_anchor_sums(t.embeddings, "label", "embedding", anchors, "anchor", "a")
    # targets are met exactly by the clusters below 5
    known = sums.filter("cluster < 5").groupBy("anchor").agg((F.sum("cubes") / F.sum("n")).alias("target"))
    trials = search.bitmask_trials(t.spark, 200, 10, 9, max_value=1023)
    return sums, known, trials


@check(
    "cluster_anchor_sums",
    with_views(
        """SELECT label AS cluster, anchor, round(sum(list_dot_product(v, a)), 6) AS dots, round(sum(list_dot_product(v, a) ** 3), 6) AS cubes, count(*) AS n
        FROM units, anchors GROUP BY label, anchor""",
        _ROWS,
        _ANCHORS,
    ),
)
def _(t: Tables):
    sums, _, _ = _subset_inputs(t)
    return sums.withColumns({"dots": rounded("dots"), "cubes": rounded("cubes")})


@check(
    "bitmask_trials",
    with_views(
        """SELECT trial_id, cluster, selected, count(vec_id) AS n FROM bits LEFT JOIN units ON label = cluster
        GROUP BY trial_id, cluster, selected""",
        _ROWS,
        _BITS,
    ),
)
def _(t: Tables):
    sizes = t.embeddings.groupBy(F.col("label").alias("cluster")).agg(F.count(F.lit(1)).alias("n"))
    clusters = t.embeddings.agg(F.max("label")).first()[0] + 1
    drawn = search.bitmask_trials(t.spark, 200, clusters, 9, max_value=1023)
    return drawn.join(sizes, "cluster", "left").select(
        "trial_id", F.col("cluster").cast("long").alias("cluster"), "selected", F.coalesce("n", F.lit(0)).alias("n")
    )


_FITS = """fits AS (SELECT trial_id, max(kept) AS kept, avg(((score - target) * 100) ** 2) AS fit FROM (
  SELECT trial_id, anchor, avg(list_dot_product(v, a) ** 3) AS score, count(*) AS kept
  FROM bits JOIN units ON label = cluster, anchors WHERE selected GROUP BY trial_id, anchor) JOIN targets USING (anchor) GROUP BY trial_id),
metrics AS (SELECT trial_id, kept, fit, kept / (SELECT count(*) FROM units) - fit AS metric FROM fits)"""


@check(
    "cluster_subset_scores",
    with_views("SELECT trial_id, kept, round(fit, 6) AS fit, round(metric, 6) AS metric FROM metrics", _ROWS, _ANCHORS, _BITS, _FITS),
)
def _(t: Tables):
    sums, known, trials = _subset_inputs(t)
    scores = search.score_subsets(trials, sums, known)
    return scores.withColumns({"fit": rounded("fit"), "metric": rounded("metric")})


@check(
    "rows_of_best_subset",
    with_views(
        """SELECT vec_id FROM units JOIN bits ON label = cluster WHERE selected
          AND trial_id = (SELECT trial_id FROM metrics ORDER BY round(metric, 9) DESC, trial_id LIMIT 1)""",
        _ROWS,
        _ANCHORS,
        _BITS,
        _FITS,
    ),
)
def _(t: Tables):
    sums, known, trials = _subset_inputs(t)
    best = search.best_subset(search.score_subsets(trials, sums, known))
    return search.rows_of_subset(t.embeddings, "label", trials, best).select("vec_id")


@check(
    "constraint_sums",
    with_views(
        """SELECT anchor, round(sum(list_dot_product(v, a)), 6) AS dot_sum, round(avg(list_dot_product(v, a)), 6) AS dot_mean,
          round(sum(list_dot_product(v, a) ** 3), 6) AS cube_sum, round(avg(list_dot_product(v, a) ** 3), 6) AS cube_mean,
          sum(list_dot_product(v, a)) BETWEEN any_value(target) - 1 AND any_value(target) + 1 AS dot_feasible,
          sum(list_dot_product(v, a) ** 3) BETWEEN any_value(target) - 1 AND any_value(target) + 1 AS cube_feasible
        FROM units, anchors JOIN targets USING (anchor) GROUP BY anchor""",
        _ROWS,
        _ANCHORS,
    ),
)
def _(t: Tables):
    sums, known, _ = _subset_inputs(t)
    checked = search.constraint_sums(sums, known)
    return checked.withColumns({c: rounded(c) for c in ("dot_sum", "dot_mean", "cube_sum", "cube_mean")})


@check(
    "score_changes",
    """SELECT step, round(score - coalesce(lag(score) OVER (ORDER BY step), 0), 6) AS change
      FROM (SELECT label AS step, avg(list_sum(embedding::DOUBLE[])) AS score FROM embeddings GROUP BY label)""",
)
def _(t: Tables):
    trace = t.embeddings.groupBy(F.col("label").alias("step")).agg(F.avg(F.aggregate(F.col("embedding").cast("array<double>"), F.lit(0.0), lambda s, x: s + x)).alias("score"))
    return search.score_changes(trace).select("step", rounded("change").alias("change"))


@check(
    "longest_word_list",
    with_views(
        f"""SELECT prompt_id, len({sql_words('rewrite_prompt')}) AS n FROM prompts
        ORDER BY n DESC, array_to_string({sql_words('rewrite_prompt')}, ' ') LIMIT 1""",
        "prompts",
    ),
)
def _(t: Tables):
    rows = t.prompts.select("prompt_id", tx.split_words(F.col("rewrite_prompt")).alias("w"))
    return search.longest(rows, "w").select("prompt_id", F.size("w").cast("long").alias("n"))
