"""BM25 search over all projects in one job.

Each project has its own statistics, so scores of different projects come from different corpora,
also when their results are merged. The texts are read once: a narrow pass leaves, for each text that has a phrase, its key,
its length and its counts, and document frequencies, scores and winners come from these. How many texts a project has
and how long they are is taken from the store's statistics; without them every text leaves a row.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rank import bm25_score, bm25_term
from ..functions.snippet import snippet
from ..functions.stem import porter_stem
from ..functions.tokens import tokenize
from ..operators.filters import filter_project
from ..operators.joins import salted_join
from ..operators.match import STEM_TAIL, Condition, Matcher
from ..operators.messages import with_search_columns
from ..session import evaluated_once, materialized
from ..sources.store import Store

PER_PROJECT = ("project_slug",)
MOST_NAMED = 4_096  # words that a plan names as literals
_START = 3
_UNIT = 1e-13  # of scores that are added up


def corpus_stats(messages: DataFrame, by: tuple[str, ...] = PER_PROJECT) -> DataFrame:
    """Number of texts and mean length, per project or (empty ``by``) of the whole corpus."""
    # the texts themselves are not carried along where their length is stored
    needed = ["norm", "doc_len"] if "norm" in messages.columns else ["content"]
    docs = with_search_columns(messages.select(*by, *needed))
    return docs.groupBy(*by).agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))


def _count(n: int, name: str) -> list[str]:
    return [f"_{name}{k}" for k in range(n)]


def _scored(
    messages: DataFrame, condition: Condition, by: tuple[str, ...], stemmed: bool, stats: DataFrame | None = None
) -> tuple[DataFrame, Matcher]:
    """Matching rows, without their texts, with their score and ``_used<k>``: whether phrase k counts in the row.

    ``stats``: ``project_slug``, ``n_docs``, ``total_len`` of all messages. The narrow rows are written to the shared
    folder, so the texts are read once although the frequencies must be known before the first score.
    """
    matcher = Matcher(with_search_columns(messages), condition, stemmed)
    n = len(matcher.phrases)
    present = _count(n, "has")
    docs = matcher.docs.withColumns({c: matcher.present(k) for k, c in enumerate(present)})
    if stats is not None:
        docs = docs.filter(reduce(or_, map(F.col, present)))
    counts = {f"_n{k}": F.when(F.col(c), matcher.occurrences(k)).otherwise(0) for k, c in enumerate(present)}
    found = materialized(docs.withColumns(counts).drop("content", "norm"), "found")

    frequencies = [F.count_if(c).alias(f"_df{k}") for k, c in enumerate(present)]
    if stats is None:
        sums = found.groupBy(*by).agg(F.count("*").alias("_n"), F.avg("doc_len").alias("_avg"), *frequencies)
    else:
        whole = stats.groupBy(*by).agg(F.sum("n_docs").alias("_n"), (F.sum("total_len") / F.sum("n_docs")).alias("_avg"))
        few = found.groupBy(*by).agg(*frequencies)
        if by:
            sums = whole.join(few, list(by))
        else:
            sums = whole.withColumn("_few", few.select(F.struct("*").alias("s")).scalar()).select("*", "_few.*").drop("_few")
    flags = matcher.by_phrase([F.col(c) for c in present])
    used = condition.counting(flags, F.lit(True))
    hits = found.filter(condition.holds(flags)).withColumns(
        {f"_used{k}": used[id(p)] for k, p in enumerate(matcher.phrases)}
    )
    hits = hits.withColumns({f"_tf{k}": F.when(F.col(f"_used{k}"), F.col(f"_n{k}")).otherwise(0) for k in range(n)})
    if by:
        hits = salted_join(hits, sums, list(by), ["uuid"])
    else:
        hits = hits.withColumn("_whole", sums.select(F.struct("*").alias("s")).scalar()).select("*", "_whole.*").drop("_whole")
    score = bm25_score(_count(n, "tf"), "doc_len", "_avg", "_n", _count(n, "df"))
    return hits.withColumn("score", score).drop(*present, *_count(n, "n"), *_count(n, "df"), "_n", "_avg"), matcher


def _with_texts(messages: DataFrame, top: DataFrame) -> DataFrame:
    """The texts of a few chosen rows, looked up by key; they are normalised after that."""
    key = ["project_slug", "uuid"]
    texts = [c for c in ("content", "norm") if c in messages.columns]
    return with_search_columns(messages.select(*key, *texts).join(top.drop("norm", "doc_len"), key))


def _tidy(frame: DataFrame) -> DataFrame:
    return frame.drop(*[c for c in frame.columns if c.startswith("_")], "norm", "doc_len")


def score_hits(
    messages: DataFrame,
    condition: Condition,
    by: tuple[str, ...] = PER_PROJECT,
    stemmed: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """All matching messages with their BM25 score (lower is better): all their columns but the text.

    ``stats`` is ``Store.search_stats()`` where ``messages`` are all of a store.
    """
    return _tidy(_scored(messages, condition, by, stemmed, stats)[0])


def topk_per_project(hits: DataFrame, k: int = 10) -> DataFrame:
    """Best ``k`` hits of every project; the row-number limit is applied before the shuffle too."""
    best = Window.partitionBy("project_slug").orderBy("score", "uuid")
    return hits.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= k).drop("_rn")


def _snippet(matcher: Matcher) -> Column:
    phrases = [
        (F.col(f"_used{k}"), matcher.blank_before(k), len(found.terms))
        for k, found in enumerate(matcher.phrases)
    ]
    return snippet("content", "norm", phrases)


def _winners(messages: DataFrame, hits: DataFrame, matcher: Matcher, limit: int) -> DataFrame:
    """The best rows; texts are looked up and snippets made for these only."""
    top = hits.orderBy("score", "uuid").limit(limit)
    return _with_texts(messages, top).withColumn("snippet", _snippet(matcher))


def search(
    messages: DataFrame,
    sessions: DataFrame,
    condition: Condition,
    slug: str | None = None,
    limit: int = 10,
    stemmed: bool = True,
    stats: DataFrame | None = None,
) -> DataFrame:
    """Best messages of one or all projects, with a snippet and their session's data.

    ``sessions`` must hold the sessions of all ``messages``, as the stored tables do. See ``search_store``.
    """
    top = _best(messages, condition, slug, limit, stemmed, stats)
    return _told(top, sessions)


def _best(messages, condition, slug, limit, stemmed, stats) -> DataFrame:
    chosen = filter_project(messages, slug)
    known = None if stats is None else filter_project(stats, slug)
    hits, matcher = _scored(chosen, condition, PER_PROJECT, stemmed, known)
    return _winners(chosen, hits, matcher, limit)


def search_store(
    store: Store, condition: Condition, slug: str | None = None, limit: int = 10, stemmed: bool = True
) -> DataFrame:
    """``search`` over a store: counts come from what each batch left, and session versions meet for the winners only."""
    top = _best(store.scan_messages(), condition, slug, limit, stemmed, store.search_stats())
    return _told(top, store.scan_sessions(of=top))


def _told(top: DataFrame, sessions: DataFrame) -> DataFrame:
    owners = sessions.select(
        "project_slug", "session_id", F.col("started_at").alias("session_started_at"), "git_branch"
    )
    # a handful of winners: the join reads two columns of the sessions and keeps the order below
    return (
        top.join(owners, ["project_slug", "session_id"])
        .select(
            F.col("uuid").alias("message_uuid"),
            "session_id",
            "timestamp",
            "role",
            "snippet",
            "score",
            "project_slug",
            "session_started_at",
            "git_branch",
        )
        .orderBy("score", "message_uuid")
    )


def _phrase_terms(queries: DataFrame, stemmed: bool) -> DataFrame:
    """(phrase, place, size, word) of every distinct phrase of the queries."""
    words = (
        queries.select(F.explode("phrases").alias("text"))
        .select(tokenize("text").alias("tokens"))
        .filter(F.size("tokens") > 0)
        .select(F.array_join("tokens", " ").alias("phrase"), "tokens")
        .distinct()
        .select("phrase", F.size("tokens").alias("size"), F.posexplode("tokens").alias("place", "word"))
    )
    return words.withColumn("word", porter_stem("word")) if stemmed else words


def _may_be_one(token: str, words: DataFrame, starts_only: bool) -> Column:
    """Whether a token may be among ``words``; always, if there are too many words to name."""
    # a word shares the start of its stem, but for the stem's last letters
    size = F.greatest(F.lit(1), F.least(F.lit(_START), F.length("word") - STEM_TAIL))
    start = F.substr(F.col("word"), F.lit(1), size) if starts_only else F.col("word")
    named = [r[0] for r in words.select(start).distinct().limit(MOST_NAMED + 1).collect()]
    if len(named) > MOST_NAMED:
        return F.lit(True)
    # tokens hold letters and digits only, so they need no quoting
    among = lambda what, texts: F.expr(f"{what} in ({', '.join(map(repr, sorted(texts)))})")
    if not starts_only:
        return among(token, named) if named else F.lit(False)
    by_size = {n: [x for x in named if len(x) == n] for n in {len(x) for x in named}}
    return reduce(or_, [among(f"substring({token}, 1, {n})", x) for n, x in by_size.items()], F.lit(False))


def _postings(docs: DataFrame, queries: DataFrame, stemmed: bool, marked: bool) -> DataFrame:
    """``project_slug``, ``uuid``, ``doc_len``, ``phrase``, ``tf`` of each phrase of the queries that a message has.

    Tokens that no query asks for end where the text is split, in generated code. A phrase of several words stands where all its places
    give the same start. ``marked`` adds a row with an empty phrase for every message.
    """
    key = ["project_slug", "uuid"]
    wanted = _phrase_terms(queries, stemmed)
    # the blank before the first token leaves an empty one in front: the mark of a message
    tokens = F.posexplode(F.split(F.rtrim("norm"), " ")).alias("at", "token")
    may = _may_be_one("token", wanted, stemmed) & (F.col("token") != "")
    if stemmed:
        # stem the vocabulary, not the texts: no condition on the stem may pass below the distinct words
        vocabulary = evaluated_once(docs.select(tokens).filter(may).select("token").distinct().withColumn("word", porter_stem("token")))
        # a table: its size is known when the texts are joined, which then need no shuffle
        spelled = materialized(vocabulary.join(wanted, "word").select("token", "phrase", "size", "place"), "spelled")
        may = _may_be_one("token", spelled.select(F.col("token").alias("word")), False) & may
    else:
        spelled = wanted.withColumnRenamed("word", "token")
    if marked:
        mark = docs.sparkSession.range(1).select(F.lit("").alias("token"), F.lit("").alias("phrase"), F.lit(1).alias("size"), F.lit(0).alias("place"))
        spelled = spelled.unionByName(mark)
    places = docs.select(*key, "doc_len", tokens).filter(may | (F.col("at") == 0) if marked else may)
    met = places.join(spelled, "token").withColumn("start", F.when(F.col("size") > 1, F.col("at") - F.col("place")))
    # counts add up before the one shuffle; written here, as the texts are not to be read for single words and phrases apart
    counted = materialized(met.groupBy(*key, "doc_len", "phrase", "size", "start").agg(F.count("*").alias("n")), "postings")
    whole = counted.filter((F.col("size") > 1) & (F.col("n") == F.col("size"))).groupBy(*key, "doc_len", "phrase").agg(F.count("*").alias("tf"))
    return counted.filter("size = 1").select(*key, "doc_len", "phrase", F.col("n").alias("tf")).unionByName(whole)


def search_many(
    messages: DataFrame, queries: DataFrame, limit: int = 10, stemmed: bool = True, stats: DataFrame | None = None
) -> DataFrame:
    """Many searches in one job: ``queries(query_id, phrases ARRAY<STRING>, match_all BOOLEAN)``.

    Each phrase is scored once per message and shared by all queries that use it. A message's shares meet in one task and add
    up for each query there; a sum goes on only if it can be among the best ``limit``: with the best share of every phrase
    in the project known, phrases that fall short of the ``limit``-th best score together bring no messages, a sum below that
    score ends where it was made, and a query that wants all phrases starts from its rarest one. The bounds are
    exact: the rows are those of comparing every message. ``stats``: ``Store.search_stats()`` of all messages.
    """
    docs = with_search_columns(messages)
    key = ["project_slug", "uuid"]
    found = _postings(docs, queries, stemmed, marked=stats is None)
    if stats is None:
        sums = found.filter("phrase = ''").groupBy("project_slug").agg(F.count("*").alias("n_docs"), F.avg("doc_len").alias("avg_len"))
        found = found.filter("phrase <> ''")
    else:
        sums = stats.select("project_slug", "n_docs", (F.col("total_len") / F.col("n_docs")).alias("avg_len"))
    # one row for each project and phrase: as a table it is known to be small, and the postings stay where they are
    df = materialized(found.groupBy("project_slug", "phrase").agg(F.count("*").alias("df")).join(sums, "project_slug"), "frequencies")
    share = bm25_term("tf", "doc_len", "avg_len", "n_docs", "df")
    # whole numbers of a small unit add up alike in any order, so equal texts get equal scores
    shares = materialized(
        found.join(df, ["project_slug", "phrase"]).select(*key, "phrase", "df", F.round(-share / _UNIT).cast("bigint").alias("gain")),
        "shares",
    )
    asked = (
        queries.select("query_id", F.coalesce("match_all", F.lit(False)).alias("match_all"), F.size("phrases").alias("asked"), F.explode("phrases").alias("text"))
        .groupBy("query_id", "match_all", "asked", F.array_join(tokenize("text"), " ").alias("phrase"))
        .agg(F.count("*").alias("times"))
    )
    # for each query, project and phrase of both: the best its share can be
    tops = shares.groupBy("project_slug", "phrase").agg(F.max("gain").alias("top"), F.first("df").alias("df"))
    parts = materialized(asked.join(tops, "phrase").withColumn("top", F.col("top") * F.col("times")), "tops")

    # the best messages of single phrases: what their whole scores reach, others must reach
    leaders = shares.withColumn("nr", F.row_number().over(Window.partitionBy("phrase").orderBy(F.desc("gain"), "uuid"))).filter(F.col("nr") <= limit)
    named = materialized(asked.filter("not match_all").join(leaders, "phrase").select("query_id", *key).distinct(), "leaders")
    reached = (
        shares.join(named, key)
        .join(parts.select("query_id", "project_slug", "phrase", "times"), ["query_id", "project_slug", "phrase"])
        .groupBy("query_id", *key)
        .agg(F.sum(F.col("gain") * F.col("times")).alias("gain"))
    )
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("gain"), "uuid"))
    least = reached.withColumn("nr", place).filter(F.col("nr") == limit).select("query_id", F.col("gain").alias("least"))
    # of a query's phrases in a project, those that are together too weak to reach it bring no messages
    weakest = Window.partitionBy("query_id", "project_slug").orderBy("top", "phrase")
    ranked = parts.filter("not match_all").join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(0)))
    any_of = ranked.withColumn("brings", F.sum("top").over(weakest) >= F.col("least"))
    # who wants all phrases starts from the rarest, in projects that have them all
    whole_query = Window.partitionBy("query_id", "project_slug")
    all_of = (
        parts.filter("match_all")
        .withColumn("least", F.lit(0).cast("bigint"))
        .withColumn("there", F.sum("times").over(whole_query))
        .filter("there = asked")
        .withColumn("brings", F.struct("df", "phrase") == F.min(F.struct("df", "phrase")).over(whole_query))
    )
    cols = ["query_id", "project_slug", "phrase", "times", "brings", "least", F.when(F.col("match_all"), F.col("asked")).otherwise(0).alias("needed")]
    bounds = materialized(any_of.select(*cols).unionByName(all_of.select(*cols)), "bounds")
    # a message's shares meet in one task, where all queries that share a phrase with it add up at once; only what a
    # phrase brought, and what reaches the least score, leaves the task
    whole = (
        shares.select(*key, "phrase", "gain")
        .repartition(*key)
        .join(bounds, ["project_slug", "phrase"])
        .groupBy("query_id", *key)
        .agg(
            F.sum(F.col("gain") * F.col("times")).alias("gain"), F.sum("times").alias("there"), F.max("brings").alias("brought"),
            F.first("least").alias("least"), F.first("needed").alias("needed"),
        )
        .filter("brought and gain >= least and there >= needed")
    )
    best = Window.partitionBy("query_id").orderBy(F.desc("gain"), "uuid")
    return (
        whole.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= limit)
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), "project_slug", "uuid", (-F.col("gain") * _UNIT).alias("score"))
    )
