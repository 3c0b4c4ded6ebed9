"""Metadata-conditioned n-gram language models."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from lexigrid.functions import text as X
from lexigrid.session import cut

BOS, EOS = "<BOS>", "<EOS>"
#: Names of the plain variant, which are no name of their own.
PLAIN_SKINS = ("classic", "original", "human form")
#: Records of one condition that one window may hold; larger conditions are read in that many-record pieces.
CHUNK = 4096


def records(df: DataFrame) -> DataFrame:
    """Usable quotes with their canonical metadata and tokens.

    Missing optional columns count as empty; quote and champion_name are required; record_id is the order.
    """
    missing = {"quote", "champion_name", "record_id"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    # one step a select: a value that a later step uses twice is computed once, and the generated code stays small
    names = ("champion_name", "resolved_skin_name", "voiceover_set", "resolved_skinline_name", "champion_region", "runeterra_region", "skin_region", "skin_universe", "region_notes")
    known = lambda c: F.when(F.lower(c).isin(*X.NO_VALUE), "").otherwise(F.col(c)).alias(c)
    t = df.select("record_id", X.strip(F.coalesce("quote", F.lit(""))).alias("quote"), *[(X.strip(F.coalesce(c, F.lit(""))) if c in df.columns else F.lit("")).alias(c) for c in names])
    t = t.select("record_id", known("quote"), *map(known, names))
    t = t.select("record_id", "quote", *[X.strip(F.regexp_replace(c, r"^\|-\|\s*", "")).alias(c) for c in names])
    for_first = ("resolved_skin_name", "voiceover_set", "champion_region", "runeterra_region", "skin_region", "skin_universe", "region_notes")
    t = t.withColumns({f"__{c}": F.nullif(known(c), F.lit("")) for c in for_first})
    first = lambda *cs: F.coalesce(*[F.col(f"__{c}") for c in cs], F.lit(""))
    t = t.select(
        "record_id", "quote", "champion_name", first("resolved_skin_name", "voiceover_set").alias("skin"), F.col("resolved_skinline_name").alias("line"), first("champion_region", "runeterra_region").alias("champion_region"),
        "skin_region", first("skin_region", "champion_region", "runeterra_region").alias("effective_region"), first("skin_universe", "region_notes").alias("skin_universe"),
    )
    plain = lambda c, out: F.when(F.lower(c).isin(*PLAIN_SKINS), "").otherwise(F.col(c)).alias(out)
    t = t.select("record_id", "quote", "champion_name", plain("skin", "skin_name"), plain("line", "line"), "champion_region", "skin_region", "effective_region", "skin_universe")
    some = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise("unknown")
    t = t.select(
        "record_id", "quote", "champion_name", "skin_name", F.concat_ws("::", some("champion_name"), some("skin_name")).alias("champion_skin"),
        F.when(F.col("line") != "", F.col("line")).when(F.contains("skin_name", F.lit(":")), F.trim(F.substring_index("skin_name", ":", 1))).otherwise(F.col("skin_name")).alias("skinline_name"),
        "champion_region", "skin_region", "effective_region", "skin_universe", X.lm_tokens(F.col("quote")).alias("tokens"),
    )
    return t.where((F.col("quote") != "") & (F.size("tokens") > 0))


def condition_summary(**cond) -> str:
    named = [(k, cond.get(k)) for k in ("champion", "skin", "skinline", "region", "universe")]
    return ", ".join(f"{k}={v}" for k, v in named if v) or "global"


def select(recs: DataFrame, champion=None, skinline=None, skin=None, region=None, universe=None, deduplicate=False, min_quotes=0) -> DataFrame:
    """The records that meet all given conditions (case ignored); of equal quotes the first, if deduplicated.

    Quotes are deduplicated when asked for or when any of champion, skinline, region or universe is given.
    """
    key = lambda v: str(v).strip().lower() if v is not None and str(v).strip().lower() not in X.NO_VALUE else ""
    c, line, s, r, u = map(key, (champion, skinline, skin, region, universe))
    out = recs
    for name, value in (("champion_name", c), ("skinline_name", line), ("effective_region", r), ("skin_universe", u)):
        if value:
            out = out.where(F.lower(name) == value)
    if s:
        out = out.where(F.lower("champion_skin") == f"{c}::{s}") if c else out.where(F.lower("skin_name") == s)
    if deduplicate or c or line or r or u:
        out = first_of_quote(out, F.lit(0))
    if min_quotes:
        n = out.limit(min_quotes).count()
        if n < max(1, min_quotes):
            raise ValueError(f"only {n} quotes for {condition_summary(champion=champion, skin=skin, skinline=skinline, region=region, universe=universe)}")
    return out


def first_of_quote(recs: DataFrame, by: Column) -> DataFrame:
    """The first record of each quote within a condition; keyed by the quote, so hot conditions are spread."""
    w = Window.partitionBy(by, F.lower(F.trim("quote"))).orderBy("record_id")
    return recs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def _grams(n: int) -> Column:
    """All n-grams of orders 1..n that start at a token, from the columns t0 .. t{n-1}."""
    forms = [F.struct(F.lit(k).alias("ord"), F.concat_ws(" ", *[f"t{i}" for i in range(k - 1)]).alias("history"), F.col(f"t{k - 1}").alias("token")) for k in range(1, n + 1)]
    return F.filter(F.array(*forms), lambda g: g["token"].isNotNull())


def continuous_counts(recs: DataFrame, n: int, by: str, chunk: int = CHUNK) -> DataFrame:
    """(cond, ord, history, token, cnt): n-grams over the condition's tokens in record order, across quotes.

    A condition is cut into chunks of records; each chunk is read with the first n - 1 tokens of the next ones,
    so that no task holds more than a chunk and no n-gram over an edge is lost.
    """
    toks = recs.select(F.col(by).alias("cond"), F.floor(F.col("record_id") / chunk).alias("chunk"), "record_id", F.posexplode("tokens").alias("pos", "tok"))
    inside = Window.partitionBy("cond", "chunk").orderBy("record_id", "pos")
    if n > 1:
        heads = toks.withColumn("k", F.row_number().over(inside)).where(F.col("k") < n).groupBy("cond", "chunk").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "tok"))), lambda x: x["tok"]).alias("head"))
        order = Window.partitionBy("cond").orderBy("chunk")  # one row per chunk
        later = F.slice(F.flatten(F.collect_list("head").over(order.rowsBetween(1, n - 1))), 1, n - 1)
        ghosts = heads.withColumn("later", later).select("cond", "chunk", F.posexplode("later").alias("pos", "tok")).select("cond", "chunk", F.lit(2**62).alias("record_id"), "pos", "tok")
        toks = toks.unionByName(ghosts)
    leads = toks.select("cond", "record_id", F.col("tok").alias("t0"), *[F.lead("tok", k).over(inside).alias(f"t{k}") for k in range(1, n)]).where(F.col("record_id") < 2**62)
    return leads.select("cond", F.explode(_grams(n)).alias("g")).select("cond", "g.*").groupBy("cond", "ord", "history", "token").agg(F.count("*").alias("cnt"))


def sentence_counts(recs: DataFrame, n: int, by: str) -> DataFrame:
    """(cond, ord, history, token, cnt): n-grams of each quote, padded with marks; no shuffle before the count."""

    def grams(k):
        padded = F.concat(F.array_repeat(F.lit(BOS), k - 1), F.col("tokens"), F.array(F.lit(EOS)))
        return F.transform(F.sequence(F.lit(1), F.size("tokens") + 1), lambda i: F.struct(F.lit(k).alias("ord"), F.array_join(F.slice(padded, i, k - 1), " ").alias("history"), F.element_at(padded, i + k - 1).alias("token")))

    every = F.concat(*[grams(k) for k in range(1, n + 1)])
    return recs.select(F.col(by).alias("cond"), F.explode(every).alias("g")).select("cond", "g.*").groupBy("cond", "ord", "history", "token").agg(F.count("*").alias("cnt"))


def mle(counts: DataFrame) -> DataFrame:
    """counts with p, the share of the token after its history.

    The totals are grouped and joined instead of read from a window, as one history (the empty one) holds all tokens.
    """
    keys = ["cond", "ord", "history"]
    totals = counts.groupBy(*keys).agg(F.sum("cnt").alias("total"))
    return counts.join(totals, keys).withColumn("p", F.col("cnt") / F.col("total")).drop("total")


def _suffix(history: Column, k: int) -> Column:
    """The last k - 1 words of a history."""
    return F.array_join(F.slice(F.split(history, " "), -(k - 1), k - 1), " ") if k > 1 else F.lit("")


def distributions(requests: DataFrame, model: DataFrame, n: int, backoff: str | None = "interpolate", alpha: float = 0.4) -> DataFrame:
    """requests (req, cond, history of n - 1 words) with (token, p) of the next word.

    backoff: None (the longest history alone), 'fallback' (the longest history that was seen) or 'interpolate'
    (every order, discounted by alpha for each step down, and renormalised). model: the result of mle().
    """
    if backoff not in (None, "fallback", "interpolate"):
        raise ValueError("backoff must be None, 'fallback' or 'interpolate'")
    orders = range(n, 0, -1) if backoff else (n,)
    asked = requests.select("req", "cond", F.explode(F.array(*[F.struct(F.lit(k).alias("ord"), _suffix(F.col("history"), k).alias("history")) for k in orders])).alias("a")).select("req", "cond", "a.*")
    hits = asked.join(model.select("cond", "ord", "history", "token", "p"), ["cond", "ord", "history"])
    if backoff == "fallback":
        best = hits.groupBy("req").agg(F.max("ord").alias("ord"))
        return hits.join(best, ["req", "ord"]).select("req", "token", "p")
    scored = hits.groupBy("req", "token").agg(F.sum(F.col("p") * F.pow(F.lit(alpha), F.lit(n) - F.col("ord"))).alias("p"))
    total = scored.groupBy("req").agg(F.sum("p").alias("total"))
    return scored.join(total, "req").select("req", "token", (F.col("p") / F.col("total")).alias("p"))


def top_k(dist: DataFrame, k: int | None) -> DataFrame:
    """The k likeliest tokens, renormalised; ties alphabetical; None or 0: unchanged."""
    if not k or k <= 0:
        return dist
    w = Window.partitionBy("req").orderBy(F.desc("p"), "token")
    best = dist.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("rank")
    return best.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("req")))


def temperature(dist: DataFrame, t: float) -> DataFrame:
    """p ** (1 / t), renormalised."""
    if t <= 0:
        raise ValueError("temperature must be > 0")
    if t == 1.0:
        return dist
    powered = dist.where("p > 0").withColumn("p", F.pow("p", F.lit(1.0 / t)))
    return powered.join(powered.groupBy("req").agg(F.sum("p").alias("total")), "req").select("req", "token", (F.col("p") / F.col("total")).alias("p"))


def perplexity(model: DataFrame, order: int) -> DataFrame:
    """(cond, n_tokens, perplexity) of each condition's own tokens under its n-grams of one order."""
    m = model.where(F.col("ord") == order)
    return m.groupBy("cond").agg(F.sum("cnt").cast("bigint").alias("n_tokens"), F.round(F.exp(-F.sum(F.col("cnt") * F.ln(F.greatest("p", F.lit(1e-12)))) / F.sum("cnt")), 6).alias("perplexity"))


def history_of(seed: Column, n: int) -> Column:
    """The last n - 1 tokens of a seed, padded with start marks on the left."""
    toks = F.coalesce(X.lm_tokens(F.coalesce(seed, F.lit(""))), F.array().cast("array<string>"))
    return F.array_join(F.slice(F.concat(F.array_repeat(F.lit(BOS), n - 1), toks), -(n - 1), n - 1), " ") if n > 1 else F.lit("")


def generate(requests: DataFrame, model: DataFrame, n: int, steps: int, backoff="interpolate", alpha=0.4, k: int | None = 8, t: float = 1.0, sentence_mode=False) -> DataFrame:
    """requests (req, cond, seed, random_seed) -> (req, text, tokens, perplexity): sampled step by step.

    Each step joins the requests still open with the model's histories; the draw is an MD5 of seed, request and
    step, so it is the same on every run and engine. The model is never collected.
    """
    state = requests.select("req", "cond", F.coalesce(F.col("random_seed"), F.lit(0)).alias("random_seed"), history_of(F.col("seed"), n).alias("history"), X.lm_tokens(F.coalesce("seed", F.lit(""))).alias("tokens"), F.lit(0.0).alias("logp"), F.lit(0).alias("n_new"), F.lit(False).alias("done"))
    for step in range(steps):
        d = temperature(top_k(distributions(state.where("NOT done"), model, n, backoff, alpha), k), t)
        w = Window.partitionBy("req").orderBy(F.desc("p"), "token")
        draws = state.select("req", (X.md5_unit(F.col("random_seed").cast("string"), F.col("req").cast("string"), F.lit(str(step))) / F.lit(float(2**32))).alias("u"))
        walked = d.withColumn("cum", F.sum("p").over(w)).join(draws, "req").where((F.col("cum") > F.col("u")) | (F.col("cum") >= 1 - 1e-12))
        chosen = walked.groupBy("req").agg(F.min_by(F.struct("token", "p"), F.struct("cum", "token")).alias("c")).select("req", "c.token", "c.p")
        j = state.join(chosen, "req", "left")
        ended = F.col("done") | F.col("token").isNull() | (F.lit(sentence_mode) & (F.col("token") == EOS))
        state = cut(
            j.select(
                "req", "cond", "random_seed",
                F.when(ended | F.lit(n == 1), F.col("history")).otherwise(F.array_join(F.concat(F.slice(F.split("history", " "), 2, max(0, n - 2)), F.array("token")), " ")).alias("history"),
                F.when(ended, F.col("tokens")).otherwise(F.concat("tokens", F.array("token"))).alias("tokens"),
                F.when(ended, F.col("logp")).otherwise(F.col("logp") + F.ln(F.greatest("p", F.lit(1e-12)))).alias("logp"),
                F.when(ended, F.col("n_new")).otherwise(F.col("n_new") + 1).alias("n_new"), ended.alias("done"),
            )
        )
    return state.select("req", detokenize(F.col("tokens")).alias("text"), "tokens", F.when(F.col("n_new") > 0, F.exp(-F.col("logp") / F.col("n_new"))).alias("perplexity"))


def detokenize(tokens: Column) -> Column:
    """Tokens as text: marks joined to the word before, a capital at the start and after . ! ?"""
    rest = F.when(F.get(tokens, 0).rlike(r"^[.!?,;:]$"), F.slice(tokens, 2, F.greatest(F.size(tokens) - 1, F.lit(0)))).otherwise(tokens)
    start = F.struct(F.lit("").alias("text"), F.lit(True).alias("cap"))

    def step(acc, tok):
        mark, stop = tok.rlike(r"^[.!?,;:]$"), tok.rlike(r"^[.!?]$")
        word = F.when(acc["cap"], F.concat(F.upper(F.substring(tok, 1, 1)), F.substr(tok, F.lit(2)))).otherwise(tok)
        text = F.when(mark, F.concat(acc["text"], tok)).when(acc["text"] == "", word).otherwise(F.concat(acc["text"], F.lit(" "), word))
        return F.struct(text.alias("text"), F.when(mark, acc["cap"] | stop).otherwise(F.lit(False)).alias("cap"))

    return F.aggregate(rest, start, step, lambda a: a["text"])


def grid(spark, **dimensions) -> DataFrame:
    """The product of the dimensions' values (a scalar counts as one value), the first varying slowest."""
    df = spark.range(1).drop("id")
    for name, values in dimensions.items():
        values = values if isinstance(values, (list, tuple)) else [values]
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def text_metrics(text: Column) -> Column:
    """A struct of token count, unique share, punctuation and sentence ends of a text, tokenised again."""
    toks = F.coalesce(X.lm_tokens(text), F.array().cast("array<string>"))
    n, punct = F.size(toks), F.size(F.filter(toks, lambda t: t.rlike(r"^[.!?,;:]$")))
    share = lambda a: F.when(n > 0, a / n).otherwise(F.lit(0.0))
    return F.struct(n.cast("bigint").alias("token_count"), share(F.size(F.array_distinct(toks))).alias("unique_token_ratio"), punct.cast("bigint").alias("punctuation_count"), share(punct).alias("punctuation_ratio"), F.size(F.filter(toks, lambda t: t.rlike(r"^[.!?]$"))).cast("bigint").alias("sentence_end_count"))


def value_lists(recs: DataFrame, dimensions) -> DataFrame:
    """(dimension, n_values, joined): the sorted named values of each dimension; a dimension's values are its vocabulary of
    names, so the list is as long as the names are many."""
    long = recs.unpivot(["record_id"], list(dimensions), "dimension", "value").where("value <> ''").select("dimension", "value").distinct()
    return long.groupBy("dimension").agg(F.count("*").alias("n_values"), F.array_join(F.array_sort(F.collect_list("value")), "|").alias("joined"))


def save_model(recs: DataFrame, counts: DataFrame, path: str, overwrite: bool = False) -> None:
    """A model as two tables: its records and its n-gram counts; an existing path is an error unless overwritten."""
    from lexigrid.sources import sinks

    sinks.write_all({"records": recs, "ngram_counts": counts}, path, overwrite=overwrite)


def load_model(spark, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/records"), spark.read.parquet(f"{path}/ngram_counts")


#: The parameters of a batch that one pass of `generate` shares; the others differ by request.
SHARED = ("top_k", "temperature", "backoff_mode", "backoff_alpha", "sentence_mode", "tokens")


def run_batch(params: DataFrame, recs: DataFrame, n: int, min_quotes: int = 1, limit: int | None = None) -> DataFrame:
    """Texts for the rows of a parameter grid: params with their number, status, text, perplexity and metrics.

    params has batch_no, region ('' is all), seed, random_seed and the columns of SHARED. A row whose region has fewer than
    min_quotes records is skipped with its reason; the limit counts the rows that are not. One pass serves
    all rows of a combination of SHARED, of which a grid has few.
    """
    both = recs.select(F.explode(F.array_distinct(F.array("effective_region", F.lit("")))).alias("cond"), "record_id", "quote", "tokens")
    # a named region is read without repeated quotes, as in `select`
    kept = first_of_quote(both.where("cond <> ''"), F.col("cond")).unionByName(both.where("cond = ''"))
    kept = cut(kept)
    size = kept.groupBy("cond").agg(F.count("*").alias("num_source_quotes"))
    model = cut(mle(continuous_counts(kept, n, "cond")))
    j = params.withColumn("cond", F.col("region")).join(size, "cond", "left").withColumn("num_source_quotes", F.coalesce("num_source_quotes", F.lit(0).cast("bigint")))
    enough = F.col("num_source_quotes") >= max(1, min_quotes)
    j = j.withColumn("status", F.when(enough, "ok").otherwise(F.concat(F.lit("skipped: only "), F.col("num_source_quotes").cast("string"), F.lit(" quotes"))))
    if limit is not None:
        done = F.sum(F.when(enough, 1).otherwise(0)).over(Window.orderBy("batch_no").rowsBetween(Window.unboundedPreceding, -1))  # a grid is small
        j = j.withColumn("__done", F.coalesce(done, F.lit(0))).where(F.col("__done") < limit).drop("__done")
    j = cut(j.withColumn("req", F.col("batch_no").cast("string")))
    out = None
    for c in j.where("status = 'ok'").select(*SHARED).distinct().orderBy(*SHARED).collect():
        same = F.lit(True)
        for name in SHARED:
            same = same & F.col(name).eqNullSafe(F.lit(c[name]))
        one = generate(j.where((F.col("status") == "ok") & same), model, n, c.tokens, c.backoff_mode, c.backoff_alpha, c.top_k, c.temperature, c.sentence_mode).select("req", "text", "perplexity")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = j.limit(0).select("req", F.lit("").alias("text"), F.lit(0.0).alias("perplexity"))
    summary = F.when(F.col("region") != "", F.concat(F.lit("region="), "region")).otherwise("global")
    return j.join(out, "req", "left").withColumn("condition_summary", summary).withColumn("m", text_metrics(F.col("text"))).select(*params.columns, "condition_summary", "num_source_quotes", "status", "text", "perplexity", "m.*")


def write_batch(batch: DataFrame, folder: str, overwrite: bool = False) -> None:
    """A batch as JSON lines and CSV, with the mean metrics by model parameters beside it."""
    from lexigrid.sources import sinks

    batch = cut(batch)
    sinks.write(batch, f"{folder}/outputs_jsonl", "json", overwrite)
    sinks.write(batch, f"{folder}/outputs_csv", "csv", overwrite)
    sinks.write(batch_diagnostics(batch), f"{folder}/diagnostics", "json", overwrite)


def batch_diagnostics(batch: DataFrame) -> DataFrame:
    """(temperature, top_k, n_ok, n_skipped, mean metrics) of a batch."""
    r = lambda c: F.round(F.avg(c), 6)
    return batch.groupBy("temperature", "top_k").agg(F.count_if(F.col("status") == "ok").alias("n_ok"), F.count_if(F.col("status") != "ok").alias("n_skipped"), r("unique_token_ratio").alias("unique_token_ratio"), r("punctuation_ratio").alias("punctuation_ratio"), r("perplexity").alias("perplexity"))
