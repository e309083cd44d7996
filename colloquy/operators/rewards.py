"""Rewards and episode metrics over logged dialogue turns.

turns(episode_id, turn_id, fact, action, ...) with one row a turn. First mentions are a
window over (episode, fact), so nothing keeps sets along a dialogue.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from colloquy.functions.parsing import denied_before
from colloquy.functions.texts import diagnosis_match, normalized
from colloquy.operators.graph import mentioned, small, units
from colloquy.sources.cache import cut

TERMINAL = ("diagnose", "answer", "final_answer")


def first_mentions(turns: DataFrame, initial: DataFrame | None = None, fact: str = "fact") -> DataFrame:
    """turns with is_new: the episode's first turn with the fact, unless the fact was known initially."""
    w = Window.partitionBy("episode_id", fact).orderBy("turn_id")
    d = turns.withColumn("is_new", F.row_number().over(w) == 1)
    if initial is not None:
        known = initial.select("episode_id", fact).distinct().withColumn("_known", F.lit(True))
        d = d.join(known, ["episode_id", fact], "left").withColumn("is_new", F.col("is_new") & F.col("_known").isNull()).drop("_known")
    return d


def running(turns: DataFrame, value: Column, out: str) -> DataFrame:
    """turns with the running sum of value within the episode."""
    w = Window.partitionBy("episode_id").orderBy("turn_id").rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn(out, F.sum(value).over(w))


def final_flag(turns: DataFrame) -> DataFrame:
    """is_final, by default the episode's last turn."""
    last = F.col("turn_id") == F.max("turn_id").over(Window.partitionBy("episode_id"))
    return turns.withColumn("is_final", F.coalesce(F.col("is_final"), last) if "is_final" in turns.columns else last)


def collected(turns: DataFrame, edges: DataFrame) -> DataFrame:
    """episode_id, turn_id, disease, item, source of turns(episode_id, disease, turn_id, fact): what a turn's fact adds.

    A symptom of the episode's own disease is itself (own); of other facts, the symptoms of the
    whole graph that their words hold (other), else the fact as it is (verbatim). Unknown and empty
    facts add nothing. Only facts that are not the disease's own are searched, each once.
    """
    f = normalized(F.col("fact"))
    t = turns.select("episode_id", "turn_id", "disease", f.alias("_f")).where((F.col("_f") != "") & (F.lower(F.trim("fact")) != "unknown"))
    own = edges.select("disease", F.col("symptom").alias("_f"), F.lit(True).alias("_own")).distinct()
    d = cut(t.hint("merge").join(own, ["disease", "_f"], "left"))  # read three times below
    rest = d.where("_own IS NULL")
    found = mentioned(rest.select("_f", F.col("_f").alias("_text")).distinct(), "_f", "_text", edges)
    rest = rest.hint("merge").join(found, "_f", "left")
    source = F.when(F.col("symptom").isNull(), "verbatim").otherwise("other")
    rest = rest.select("episode_id", "turn_id", "disease", F.coalesce("symptom", "_f").alias("item"), source.alias("source"))
    return d.where("_own").select("episode_id", "turn_id", "disease", F.col("_f").alias("item"), F.lit("own").alias("source")).unionByName(rest)


#: Kinds of lines that :func:`_credited` sorts into one table.
_EDGE, _START, _TURN, _OTHER = range(4)


def _keys(own: Column, others: Column | None = None) -> Column:
    """The lines of a turn: its own key, and others."""
    line = lambda k, key: F.struct(F.lit(k).alias("_kind"), key.alias("_key"))
    first = F.array(line(_TURN, own))
    return (first if others is None else F.concat(first, F.transform(others, lambda x: line(_OTHER, x)))).alias("_keys")


def _weights(edges: DataFrame) -> DataFrame:
    """disease, symptom, _w; written, since both its symptoms and its weights are read."""
    return cut(edges.where("disease IS NOT NULL AND symptom IS NOT NULL").select("disease", "symptom", units(F.col("weight")).alias("_w")))


def _credited(d: DataFrame, columns: list[str], edges: DataFrame, initial: DataFrame | None = None, own_only: bool = False) -> DataFrame:
    """d(columns, _keys, _told, _itself) -> columns with is_final, _total, _gain and _new of the turn, _hit and n_new up to it, _again.

    A turn tells the first of _keys if it is told and itself or the disease's own, and the others unless the first is the
    disease's own; with ``own_only`` it tells those of the others that are. edges(disease, symptom, _w) have the weights, the
    largest of a pair counts; initial is as in :func:`graph_turn_rewards`. An episode has one disease, so edges, starts
    and turns lie side by side by disease: one shuffle, and windows inside it instead of joins. A disease's hash comes
    before its name, since names that begin alike are slow to sort.
    """
    kind, by = F.col("_kind"), ["_d", "disease"]
    rest = [c for c in columns if c not in ("disease", "episode_id", "turn_id")]
    none = lambda c: F.lit(None).cast(d.schema[c].dataType).alias(c)
    lines = d.select("disease", "episode_id", "turn_id", "_told", "_itself", *rest, F.explode("_keys").alias("_k"))
    lines = lines.select("disease", "episode_id", "turn_id", "_k._kind", "_k._key", F.lit(None).cast("long").alias("_w"), "_told", "_itself", *(F.when(F.col("_k._kind") == _TURN, F.col(c)).alias(c) for c in rest))
    blank = [F.lit(False).alias("_told"), F.lit(False).alias("_itself"), *map(none, rest)]
    all_ = lines.unionByName(edges.select("disease", none("episode_id"), none("turn_id"), F.lit(_EDGE).alias("_kind"), F.col("symptom").alias("_key"), "_w", *blank))
    if initial is not None:
        if "disease" not in initial.columns:
            initial = initial.hint("merge").join(d.select("episode_id", "disease").distinct(), "episode_id")
        all_ = all_.unionByName(initial.select("disease", "episode_id", none("turn_id"), F.lit(_START).alias("_kind"), normalized(F.col("fact")).alias("_key"), F.lit(None).cast("long").alias("_w"), *blank))
    all_ = all_.withColumn("_d", F.xxhash64("disease")).repartition("_d")
    pair = Window.partitionBy(*by, "_key").orderBy("_kind", F.desc("_w"))
    upto = pair.rowsBetween(Window.unboundedPreceding, 0)
    all_ = all_.withColumns({"_one": F.row_number().over(pair), "_own": F.first("_kind").over(upto) == _EDGE, "_w": F.first("_w").over(upto)})
    total = F.sum(F.when((kind == _EDGE) & (F.col("_one") == 1), F.col("_w"))).over(Window.partitionBy(*by))
    all_ = all_.withColumn("_total", F.nullif(total, F.lit(0))).where((kind == _TURN) | (kind == _OTHER) | ((kind == _START) & F.col("_own"))).drop("_one")
    case = Window.partitionBy(*by, "episode_id")
    if own_only:
        tells = F.col("_own") & (kind != _TURN)
    else:
        parent = F.max(F.when(kind == _TURN, F.col("_own"))).over(Window.partitionBy(*by, "episode_id", "turn_id"))
        all_ = all_.withColumn("_parent", parent)
        tells = F.when(kind == _START, True).when(kind == _TURN, F.col("_told") & (F.col("_own") | F.col("_itself"))).otherwise(~F.col("_parent"))
    item = Window.partitionBy(*by, "episode_id", "_key").orderBy(F.desc("_tells"), F.asc_nulls_first("turn_id"), "_kind")
    first = F.first(F.struct("_tells", "_kind", "turn_id")).over(item.rowsBetween(Window.unboundedPreceding, 0))
    all_ = all_.withColumn("_tells", tells).withColumns({"_first": first, "_n": F.row_number().over(item)})
    new = F.col("_tells") & (F.col("_n") == 1)
    again = F.col("_first._tells") & ((F.col("_first._kind") == _START) | F.coalesce(F.col("_first.turn_id") < F.col("turn_id"), F.lit(False)))
    all_ = all_.select(
        *by, "episode_id", "turn_id", *rest, "_kind", "_total", again.alias("_again"),
        F.when(new, F.coalesce("_w", F.lit(0))).otherwise(0).alias("_g"), F.when(new & (kind != _START), 1).otherwise(0).cast("long").alias("_c"),
    )
    so_far, turn = case.orderBy(F.asc_nulls_first("turn_id")).rangeBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy(*by, "episode_id", "turn_id")
    all_ = all_.withColumns({"_hit": F.sum("_g").over(so_far), "n_new": F.sum("_c").over(so_far), "_gain": F.sum("_g").over(turn), "_new": F.sum("_c").over(turn)})
    last = F.col("turn_id") == F.max("turn_id").over(case)
    all_ = all_.withColumn("is_final", F.coalesce(F.col("is_final"), last) if "is_final" in columns else last)
    return all_.where(kind == _TURN).drop("_d", "_kind", "_g", "_c")


def _diagnosed() -> Column:
    """Whether the last turn names the disease; only last turns' diagnoses are read."""
    right = F.coalesce(diagnosis_match(F.col("diagnosis"), F.col("disease")), F.lit(False))
    return F.when(F.col("is_final"), (F.col("action") == "diagnose") & right).otherwise(F.col("is_final"))


def graph_turn_rewards(turns: DataFrame, edges: DataFrame, initial: DataFrame | None = None, beta: float = 1.0, turn_coef: float = 0.4, r_max: float = 1.0, r_wrong: float = 0.0, r_timeout: float = -2.0, tau: float = 0.6, min_new: int = 2) -> DataFrame:
    """turns(episode_id, disease, turn_id, fact, action, diagnosis) with delta, coverage, n_new, r_diag, reward, is_correct, premature, is_duplicate.

    An item (as in :func:`collected`) counts at its first mention, unless initial(episode_id, fact), which may have the
    disease too and is cut to its own symptoms, has it. New symptoms of the disease add their share of its
    weight, on top of the initial coverage; other items count as new facts only. The last turn adds the
    outcome of its diagnosis. A fact collected before its turn is a duplicate. Turns are read twice.
    """
    edges = _weights(edges)
    turns_ = turns.withColumn("_key", normalized(F.col("fact")))
    told = F.coalesce((F.col("_key") != "") & (F.lower(F.trim("fact")) != "unknown"), F.lit(False))
    facts = turns_.where(told).select("_key", F.col("_key").alias("_text")).distinct()
    found = mentioned(facts, "_key", "_text", edges).groupBy("_key").agg(F.collect_list("symptom").alias("_found"))
    found = small(found.select("_key", F.array_contains("_found", F.col("_key")).alias("_same"), _keys(F.col("_key"), F.filter("_found", lambda x: x != F.col("_key")))))
    d = turns_.join(found, "_key", "left")
    d = d.select(*turns.columns, told.alias("_told"), (told & F.coalesce("_same", F.lit(True))).alias("_itself"), F.when(told & F.col("_keys").isNotNull(), F.col("_keys")).otherwise(_keys(F.col("_key"))).alias("_keys"))
    d = _credited(d, turns.columns, edges, initial)
    share = lambda c: F.coalesce(F.col(c) / F.col("_total"), F.lit(0.0))
    d = d.withColumns({"delta": share("_gain"), "coverage": share("_hit")})
    # coverage >= tau, without a quotient
    enough = F.coalesce(F.col("_hit").cast("decimal(38,0)") * 1_000_000 >= F.col("_total").cast("decimal(28,0)") * round(tau * 1_000_000), F.lit(tau <= 0))
    correct = _diagnosed()
    r_diag = F.when(~F.col("is_final"), 0.0).when(F.col("action") != "diagnose", r_timeout).when(correct, r_max).otherwise(r_wrong)
    d = d.withColumns({"is_correct": correct, "r_diag": r_diag, "is_duplicate": F.col("_again") & ~F.col("is_final")})
    d = d.withColumn("premature", F.col("is_correct") & ~(enough & (F.col("n_new") >= min_new)))
    return d.withColumn("reward", turn_coef * beta * F.col("delta") + F.col("r_diag")).drop("_new", "_again", "_gain", "_hit", "_total")


def fact_turn_rewards(turns: DataFrame, facts: DataFrame, beta: float = 1.0, turn_coef: float = 0.4, r_correct: float = 1.0, r_wrong: float = 0.0, r_timeout: float = -2.0) -> DataFrame:
    """turns(episode_id, turn_id, fact, action, answer, answer_idx), facts(episode_id, fact): uniform weights.

    Only ask turns add facts: one that the case lacks is unknown, one already asked is a
    duplicate, another adds beta / (facts of the case, 1 at least). Facts and turns lie side by side by
    episode: one shuffle, and windows inside it instead of joins.
    """
    kinds = turns.schema
    none = [F.lit(None).cast(kinds[c].dataType).alias(c) for c in turns.columns if c not in ("episode_id", "fact")]
    d = turns.withColumn("_fact", F.lit(False)).unionByName(facts.where("episode_id IS NOT NULL").select("episode_id", "fact", *none, F.lit(True).alias("_fact")))
    pair, case = Window.partitionBy("episode_id", "fact"), Window.partitionBy("episode_id")
    d = d.repartition("episode_id").withColumns({"_own": F.max("_fact").over(pair) & F.col("fact").isNotNull(), "_one": F.row_number().over(pair.orderBy(F.desc("_fact")))})
    d = d.withColumn("n_facts", F.nullif(F.sum((F.col("_fact") & (F.col("_one") == 1)).cast("long")).over(case), F.lit(0)))
    d = final_flag(d.where(~F.col("_fact")).drop("_fact", "_one"))
    ask = F.col("action") == "ask"
    known = ask & F.col("_own")
    k = F.row_number().over(Window.partitionBy("episode_id", "fact", known).orderBy("turn_id"))
    d = d.withColumns({"is_unknown": ask & ~F.col("_own"), "is_duplicate": known & (k > 1), "_gain": known & (k == 1)})
    total = F.greatest(F.coalesce("n_facts", F.lit(0)), F.lit(1))
    d = d.withColumn("delta", F.when(F.col("_gain"), beta / total).otherwise(F.lit(0.0)))
    answered = F.col("action") == "answer"
    r = F.when(~F.col("is_final"), 0.0).when(~answered, r_timeout).when(F.upper(F.trim("answer")) == F.upper(F.trim("answer_idx")), r_correct).otherwise(r_wrong)
    return d.withColumn("r_diag", r).withColumn("reward", turn_coef * F.col("delta") + F.col("r_diag")).drop("_own", "_gain")


REFUSAL = "The patient cannot answer this question."


def verifier_rewards(turns: DataFrame, fmt: float = 0.1, verify: float = 0.4, effective: float = 0.5, correct: float = 1.0) -> DataFrame:
    """turns(text, verifier, patient, answer_idx, is_final) with valid, kind, process_reward, outcome_reward.

    A turn is a question or a final answer after its thoughts. Questions earn by the
    verifier's tag: normal (more if the patient could answer), half on timeout, all on the
    patient's timeout; an unknown tag is an error. Answers earn all, and more if right.
    """
    after = F.trim(F.regexp_extract("text", r"(?is)<think>.*?</think>(.*)$", 1))
    kind = F.when(after.startswith("Question:"), "question").when(after.startswith("Final Answer:"), "final_answer")
    d = turns.withColumns({"_after": after, "kind": kind})
    q = (F.col("kind") == "question") & ~F.col("is_final")
    v = F.col("verifier")
    fine = F.col("patient").isNotNull() & (F.col("patient") != "") & (F.col("patient") != REFUSAL)
    tag = (
        F.when(v.isNull() | v.isin("<Multiple>", "<Repeated>", "<ERROR_RESPONSE>"), 0.0)
        .when(v == "<Timeout>", verify / 2)
        .when(v == "<HUMAN_Timeout>", verify)
        .when(v == "<Normal>", F.when(fine, verify + effective).otherwise(verify))
        .otherwise(F.raise_error(F.concat(F.lit("unknown verifier tag "), v)).cast("double"))
    )
    process = F.when(F.col("kind").isNull(), 0.0).when(F.col("kind") == "final_answer", fmt + verify + effective).when(q, fmt + tag).otherwise(fmt)
    answer = F.upper(F.trim(F.replace(F.substring("_after", 14, 1 << 30), F.lit("<|im_end|>"), F.lit(""))))
    right = (F.col("kind") == "final_answer") & (answer == F.upper(F.trim("answer_idx")))
    return d.withColumns({"valid": F.col("kind").isNotNull(), "process_reward": process, "is_correct": F.coalesce(right, F.lit(False))}).withColumn("outcome_reward", F.when(F.col("is_correct"), correct).otherwise(0.0)).drop("_after")


def episode_metrics(turns: DataFrame) -> DataFrame:
    """Per episode of :func:`graph_turn_rewards`: sum of gains, share of asks and diagnoses, last coverage, outcome flags."""
    return turns.groupBy("episode_id").agg(
        F.sum("delta").alias("delta_sum"),
        F.avg(F.col("action").isin("ask", "diagnose").cast("double")).alias("valid_format_rate"),
        F.max_by("coverage", "turn_id").alias("coverage"),
        F.bool_or("is_correct").alias("is_correct"),
        F.bool_or("premature").alias("premature"),
        F.count("*").alias("turn_count"),
    )


def fact_metrics(turns: DataFrame) -> DataFrame:
    """Per episode of :func:`fact_turn_rewards`: totals, rates and the coverage of the case's facts. is_no_eos is taken as false where turns lack it."""
    asks = F.greatest(F.count_if(F.col("action") == "ask"), F.lit(1))
    no_eos = F.col("is_no_eos") if "is_no_eos" in turns.columns else F.lit(False)
    right = F.col("is_final") & (F.col("action") == "answer") & (F.upper(F.trim("answer")) == F.upper(F.trim("answer_idx")))
    new = (F.col("action") == "ask") & ~F.col("is_unknown") & ~F.col("is_duplicate")
    return turns.groupBy("episode_id").agg(
        F.count("*").alias("turn_count"),
        F.sum("reward").alias("reward_sum"), F.avg("reward").alias("reward_mean"), F.sum("delta").alias("delta_sum"),
        F.max_by("r_diag", "turn_id").alias("r_diag"),
        F.bool_or(F.coalesce(right, F.lit(False))).alias("is_correct"), F.bool_or(F.col("action") == "answer").alias("answered"),
        F.avg(F.col("action").isin("ask", "answer").cast("double")).alias("valid_format_rate"), F.avg(no_eos.cast("double")).alias("no_eos_rate"),
        (F.count_if("is_unknown") / asks).alias("unknown_rate"), (F.count_if("is_duplicate") / asks).alias("duplicate_rate"),
        (F.count_if(new) / F.greatest(F.max(F.coalesce("n_facts", F.lit(0))), F.lit(1))).alias("fact_coverage"),
    )


def verifier_metrics(turns: DataFrame) -> DataFrame:
    """Per episode of :func:`verifier_rewards`(episode_id, turn_id, verifier, patient, is_final): eight rates over the turns before the last, which add up to 1, and the last turn's is_valid and is_correct. Rates are 0 without such turns."""
    v, fine = F.col("verifier"), F.col("patient").isNotNull() & (F.col("patient") != "") & (F.col("patient") != REFUSAL)
    kinds = {
        "incorrect_format": ~F.col("valid"), "multiple": v == "<Multiple>", "repeated": v == "<Repeated>", "verify_timeout": v == "<Timeout>",
        "effective": (v == "<Normal>") & fine, "human_reject": (v == "<Normal>") & ~fine, "human_timeout": v == "<HUMAN_Timeout>", "assistant_error": v.isNull() | (v == "<ERROR_RESPONSE>"),
    }
    early = ~F.col("is_final")
    n = F.greatest(F.count_if(early), F.lit(1))
    rates = [(F.count_if(early & (c if k == "incorrect_format" else F.col("valid") & F.coalesce(c, F.lit(False)))) / n).alias(f"{k}_rate") for k, c in kinds.items()]
    last = [F.bool_or(F.col("is_final") & (F.col("kind") == "final_answer")), F.bool_or(F.col("is_final") & F.col("is_correct"))]
    return turns.groupBy("episode_id").agg(F.count("*").alias("turn_count"), *rates, F.coalesce(last[0], F.lit(False)).alias("is_valid"), F.coalesce(last[1], F.lit(False)).alias("is_correct"))


def trajectories(turns: DataFrame) -> DataFrame:
    """Per episode its turns, in order, as an array of structs."""
    cols = [c for c in turns.columns if c not in ("episode_id", "turn_id")]
    return turns.groupBy("episode_id").agg(F.sort_array(F.collect_list(F.struct("turn_id", *cols))).alias("turns"))


def link_facts(turns: DataFrame, facts: DataFrame, unknown: str = "unknown") -> DataFrame:
    """turns(episode_id, turn_id, fact_id, fact_text) -> the fact's text by id, else the turn's own, else unknown; and the id checked against the case, else found by text, else unknown."""
    f = facts.select("episode_id", "fact_id", F.col("fact_id").alias("_id"), F.col("text").alias("_text"))
    by_id = turns.join(f, ["episode_id", "fact_id"], "left")
    g = facts.groupBy("episode_id", F.lower(F.trim("text")).alias("_key")).agg(F.min("fact_id").alias("_by_text"))
    d = by_id.withColumn("_key", F.lower(F.trim("fact_text"))).join(g, ["episode_id", "_key"], "left")
    return d.withColumns({"text": F.coalesce("_text", "fact_text", F.lit(unknown)), "checked_id": F.coalesce("_id", "_by_text", F.lit(unknown))}).drop("_id", "_text", "_key", "_by_text")


def question_checks(questions: DataFrame, threshold: float = 0.7, multiple_first: bool = False) -> DataFrame:
    """questions(conv_id, turn, text) -> verifier: <Multiple> (over one question mark), <Repeated> (Jaccard over the threshold with an earlier one), else <Normal>.

    Questions of a dialogue with the same words are one set, known by its first turn. Sets of a dialogue meet on
    the rarest of their words there, as many as two sets of that similarity must share one of, and are then
    compared; no row carries other questions along, and a long dialogue is not all its pairs.
    """
    toks = F.array_sort(F.array_distinct(F.filter(F.split(F.lower("text"), r"\s+"), lambda w: w != "")))
    d = questions.withColumn("_t", toks)
    sets = cut(d.where(F.size("_t") > 0).groupBy("conv_id", "_t").agg(F.min("turn").alias("_first")))
    words_ = sets.select("conv_id", "_first", F.size("_t").alias("_n"), F.explode("_t").alias("_w"))
    often = words_.groupBy("conv_id", "_w").agg(F.count("*").alias("_f"))
    order = Window.partitionBy("conv_id", "_first").orderBy("_f", "_w")
    rare = words_.hint("merge").join(often, ["conv_id", "_w"]).withColumn("_k", F.row_number().over(order))
    # of two sets, the larger shows n - ceil(t n) + 1 words, the smaller n - ceil(2 t / (1 + t) n) + 1, which is about half of that
    shown = lambda share: F.col("_k") <= F.col("_n") - F.ceil(F.lit(share) * F.col("_n") - 1e-9) + 1
    rare = cut(rare.where(shown(threshold)).select("conv_id", "_first", "_n", "_w", shown(2 * threshold / (1 + threshold)).alias("_few")))
    small = rare.where("_few").select("conv_id", "_w", F.col("_first").alias("_other"), F.col("_n").alias("_m"))
    met = rare.hint("merge").join(small, ["conv_id", "_w"]).where((F.col("_other") != F.col("_first")) & (F.col("_m") <= F.col("_n")) & (F.col("_m") >= threshold * F.col("_n")))
    met = met.select("conv_id", F.greatest("_first", "_other").alias("_first"), F.least("_first", "_other").alias("_early")).distinct()
    met = met.hint("merge").join(sets.select("conv_id", "_first", "_t"), ["conv_id", "_first"]).hint("merge").join(sets.select("conv_id", F.col("_first").alias("_early"), F.col("_t").alias("_o")), ["conv_id", "_early"])
    both = F.size(F.array_intersect("_o", "_t"))
    close = met.where(both / (F.size("_o") + F.size("_t") - both) > threshold).select("conv_id", "_first").distinct().withColumn("_close", F.lit(True))
    # a set that comes again is as near to itself as can be
    known = sets.hint("merge").join(close, ["conv_id", "_first"], "left").select("conv_id", "_t", "_first", "_close")
    d = d.hint("merge").join(known, ["conv_id", "_t"], "left")
    many, again = F.regexp_count("text", F.lit(r"\?")) > 1, F.coalesce(F.col("_close") | (F.lit(threshold < 1) & (F.col("_first") < F.col("turn"))), (F.lit(threshold < 1) & (F.col("_first") < F.col("turn"))), F.lit(False))
    first, second = (("<Multiple>", many), ("<Repeated>", again)) if multiple_first else (("<Repeated>", again), ("<Multiple>", many))
    return d.select(*questions.columns, F.when(first[1], first[0]).when(second[1], second[0]).otherwise("<Normal>").alias("verifier"))


#: A word that more statements of one dialogue than this have is common there.
COMMON_STATEMENTS = 200


def best_statements(questions: DataFrame, statements: DataFrame, used: float = 0.25, common: int = COMMON_STATEMENTS) -> DataFrame:
    """questions(conv_id, turn, words), statements(conv_id, fact_id, words), words as arrays without repeats -> conv_id, turn, fact_id: the dialogue's statement that shares most words with each question, one already made (fact_id < turn) counting ``used`` less, ties to the smallest fact_id; questions whose best score is not above 0 are left out.

    They meet on words that are not common in their dialogue, and such pairs get their exact score. Statements
    that share nothing but common words with a question score alike if they have the same common words, so of such a
    family only its first statement, and the first that is not yet made, can be best: a long dialogue is not all
    its pairs.
    """
    f = statements.select("conv_id", "fact_id", F.explode("words").alias("_w"))
    often = f.groupBy("conv_id", "_w").agg((F.count("*") > common).alias("_hot"))
    f = cut(f.hint("merge").join(often, ["conv_id", "_w"]))
    q = questions.select("conv_id", "turn", F.explode("words").alias("_w"))
    q = cut(q.hint("merge").join(f.groupBy("conv_id", "_w").agg(F.max("_hot").alias("_hot")), ["conv_id", "_w"]))
    met = q.where(~F.col("_hot")).select("conv_id", "turn", "_w").hint("merge").join(f.where(~F.col("_hot")).select("conv_id", "fact_id", "_w"), ["conv_id", "_w"]).select("conv_id", "turn", "fact_id").distinct()
    met = met.hint("merge").join(questions.select("conv_id", "turn", "words"), ["conv_id", "turn"]).hint("merge").join(statements.select("conv_id", "fact_id", F.col("words").alias("_v")), ["conv_id", "fact_id"])
    cost = F.when(F.col("fact_id") < F.col("turn"), used).otherwise(0.0)
    exact = met.select("conv_id", "turn", "fact_id", (F.size(F.array_intersect("words", "_v")) - cost).alias("score"))
    own = f.where("_hot").groupBy("conv_id", "fact_id").agg(F.sort_array(F.collect_list("_w")).alias("_set"))
    family = cut(own.groupBy("conv_id", "_set").agg(F.min("fact_id").alias("_first")))
    member = own.hint("merge").join(family, ["conv_id", "_set"]).select("conv_id", "_first", F.col("fact_id").alias("_t"), F.lit(1).alias("_is"), "fact_id", F.lit(None).cast("long").alias("_n"), F.lit(None).cast(questions.schema["turn"].dataType).alias("turn"))
    asked = q.where("_hot").hint("merge").join(family.select("conv_id", "_first", F.explode("_set").alias("_w")), ["conv_id", "_w"]).groupBy("conv_id", "turn", "_first").agg(F.count("*").alias("_n"))
    asked = asked.select("conv_id", "_first", F.col("turn").alias("_t"), F.lit(0).alias("_is"), F.lit(None).cast(statements.schema["fact_id"].dataType).alias("fact_id"), "_n", "turn")
    later = Window.partitionBy("conv_id", "_first").orderBy("_t", "_is").rowsBetween(1, Window.unboundedFollowing)
    line = member.unionByName(asked).withColumn("_next", F.first("fact_id", ignorenulls=True).over(later)).where("_n IS NOT NULL")
    two = line.select("conv_id", "turn", "_n", F.explode(F.array_distinct(F.array("_first", F.coalesce("_next", "_first")))).alias("fact_id"))
    alike = two.select("conv_id", "turn", "fact_id", (F.col("_n") - cost).alias("score"))
    best = exact.unionByName(alike).where("score > 0").groupBy("conv_id", "turn").agg(F.min(F.struct((-F.col("score")).alias("_s"), F.col("fact_id").alias("fact_id"))).alias("_b"))
    return best.select("conv_id", "turn", F.col("_b.fact_id").alias("fact_id"))


def place_rewards(turn_rewards: DataFrame, spans: DataFrame, value: str, seq: str = "sample_id") -> DataFrame:
    """seq, pos, value: each turn's reward at its span's last token; what has no span is added at the sequence's last span."""
    last = spans.groupBy(seq).agg(F.max("end").alias("_last"))
    d = turn_rewards.hint("merge").join(spans.select(seq, "turn_id", "end"), [seq, "turn_id"], "left").hint("merge").join(last, seq)
    return d.groupBy(seq, F.coalesce("end", "_last").alias("pos")).agg(F.sum(value).alias(value))


def text_turn_rewards(turns: DataFrame, edges: DataFrame, **params: float) -> DataFrame:
    """:func:`graph_turn_rewards` where turns(episode_id, disease, turn_id, text, action, diagnosis) have no fact ids.

    The graph's dictionary finds symptoms in each text once, however many turns have it (an equality join on
    n-grams); a symptom with a denial among the five words before it doesn't count. A turn may collect several
    symptoms, so gains are summed by turn.
    """
    edges = _weights(edges)
    texts = turns.where("text IS NOT NULL").select(F.col("text").alias("_key"), F.col("text").alias("_text")).distinct()
    found = mentioned(texts, "_key", "_text", edges).where(~denied_before(F.col("_key"), F.col("symptom")))
    none = F.lit(None).cast("string")
    found = small(found.groupBy(F.col("_key").alias("text")).agg(_keys(none, F.collect_list("symptom"))))
    d = turns.join(found, "text", "left").withColumns({"_keys": F.coalesce("_keys", _keys(none)), "_told": F.lit(False), "_itself": F.lit(False)})
    d = _credited(d, turns.columns, edges, own_only=True).withColumnsRenamed({"n_new": "n_collected", "_new": "n_new"})
    share = lambda c: F.coalesce(F.col(c) / F.col("_total"), F.lit(0.0))
    d = d.withColumns({"delta": share("_gain"), "coverage": share("_hit")}).drop("_gain", "_hit", "_total", "_again")
    beta, coef = params.get("beta", 1.0), params.get("turn_coef", 0.4)
    right = _diagnosed()
    r = F.when(~F.col("is_final"), 0.0).when(F.col("action") != "diagnose", params.get("r_timeout", -2.0)).when(right, params.get("r_max", 1.0)).otherwise(params.get("r_wrong", 0.0))
    return d.withColumns({"is_correct": right, "reward": coef * beta * F.col("delta") + r})
