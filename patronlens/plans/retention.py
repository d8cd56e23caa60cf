"""The retention run over all high-risk customers: as one plan over attempts made before, or round by round."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from patronlens.fixed_values import MAX_ATTEMPTS
from patronlens.operators import offers as o
from patronlens.operators.scoring import by_risk, high_risk
from patronlens.sources.storage import stash


@dataclass(frozen=True)
class RetentionRun:
    outcomes: DataFrame
    interventions: DataFrame


def unprofiled_high_risk(predictions: DataFrame, profiles: DataFrame) -> DataFrame:
    """High-risk customers without a profile; a run counts them as failed."""
    return high_risk(predictions).join(profiles, "customer_id", "left_anti")


def retention_run(
    predictions: DataFrame,
    profiles: DataFrame,
    proposals: DataFrame,
    products: DataFrame,
    limit: int | None = None,
) -> RetentionRun:
    """High-risk customers, their first valid offer and how each customer ended.

    ``limit`` takes that many customers from the top of the risk order; None or 0 takes all.
    """
    chosen = high_risk(predictions)
    if limit:
        chosen = by_risk(chosen, limit)
    chosen = chosen.select("customer_id")
    of_chosen = proposals.join(chosen, "customer_id", "left_semi")
    valid = o.first_valid(o.accepted(o.check_offers(of_chosen, products)))
    has_profile = profiles.select("customer_id", F.lit(True).alias("has_profile"))
    joined = chosen.join(has_profile, "customer_id", "left").join(
        valid.withColumn("has_offer", F.lit(True)), "customer_id", "left"
    )
    status = (
        F.when(F.col("has_profile").isNull(), "no_profile")
        .when(F.col("has_offer").isNull(), "no_valid_offer")
        .otherwise("succeeded")
    )
    outcomes = joined.withColumn("status", status)
    interventions = outcomes.filter(F.col("status") == "succeeded").select(
        F.col("offer_customer_id").alias("customer_id"), "discount_pct", "channel", "product_focus", "messaging"
    )
    return RetentionRun(outcomes.select("customer_id", "status"), interventions)


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    result = F.when(F.col("status") == "succeeded", "succeeded").otherwise("failed")
    return outcomes.groupBy(result.alias("result")).agg(F.count(F.lit(1)).alias("n_customers"))


# --- rounds ----------------------------------------------------------------------------------

# What proposes offers: given the requests of a round and its number, (customer_id, payload) rows.
Answer = Callable[[DataFrame, int], DataFrame]


@dataclass(frozen=True)
class RetryRounds:
    requests: DataFrame  # customer_id, attempt, feedback and the context, of every request made
    answers: DataFrame  # every answer with the rules it breaks
    state: DataFrame  # customer_id, attempt, accepted, feedback: how each request ended


def retry_rounds(contexts: DataFrame, answer: Answer, products: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> RetryRounds:
    """Ask for an offer for every context, and again with the last failure until it is valid or attempts run out.

    A round asks for the customers whose earlier answers all failed; ``feedback`` holds the
    rules that the last one broke, or ``no_answer``. Of several answers to a request one
    valid one is enough, else the least list of rules is the feedback. The contexts, and the
    state and the checked answers of each round are stored, so no round builds the contexts
    again, a lost executor repeats neither the questions nor the checks, and later rounds
    join few narrow rows.
    """
    base = stash(contexts.drop("feedback"), "contexts")
    unasked = F.lit(None).cast("string").alias("feedback")
    open_now = base.select("customer_id", unasked)
    rounds, asked, checked = [], [], []
    for attempt in range(1, max_attempts + 1):
        number = F.lit(attempt).alias("attempt")
        asked_now = stash(open_now, f"open-{attempt}")
        requests = base.join(asked_now, "customer_id").select("*", number)
        answers = answer(requests, attempt).select("customer_id", number, "payload")
        found = stash(o.check_offers(answers, products), f"answers-{attempt}")
        ended = found.groupBy("customer_id").agg(
            F.bool_or(F.size("reasons") == 0).alias("accepted"), F.min(F.concat_ws(", ", "reasons")).alias("rules")
        )
        accepted = F.coalesce("accepted", F.lit(False))
        state = asked_now.select("customer_id").join(ended, "customer_id", "left").select(
            "customer_id",
            number,
            accepted.alias("accepted"),
            F.when(~accepted, F.coalesce("rules", F.lit("no_answer"))).alias("feedback"),
        )
        state = stash(state, f"state-{attempt}")
        open_now = state.filter("NOT accepted").select("customer_id", "feedback")
        rounds.append(state)
        asked.append(asked_now.select("*", number))
        checked.append(found)
    union = lambda parts: reduce(DataFrame.unionByName, parts)
    return RetryRounds(base.join(union(asked), "customer_id"), union(checked), union(rounds))


def run_with_retries(
    predictions: DataFrame,
    profiles: DataFrame,
    explanations: DataFrame,
    candidates: DataFrame,
    answer: Answer,
    products: DataFrame,
    limit: int | None = None,
) -> DataFrame:
    """How each high-risk customer ended, with the explanation and the offer that was accepted.

    Customers without a profile or explanation aren't asked for; ``attempts`` counts the
    requests made. ``limit`` takes that many customers from the top of the risk order.
    """
    chosen = high_risk(predictions)
    chosen = stash(by_risk(chosen, limit) if limit else chosen, "high-risk")
    own = [df.join(chosen.select("customer_id"), "customer_id", "left_semi") for df in (profiles, explanations, candidates)]
    own[1] = stash(own[1], "explanations")
    explained = o.explanation_json(own[1])
    rounds = retry_rounds(o.offer_context(*own), answer, products)
    made = rounds.state.groupBy("customer_id").agg(F.max("attempt").alias("attempts"))
    valid = o.first_valid(o.accepted(rounds.answers)).select(
        "customer_id", "discount_pct", "channel", "product_focus", "messaging", F.lit(True).alias("has_offer")
    )
    rows = (
        chosen.join(profiles.select("customer_id", F.lit(True).alias("has_profile")), "customer_id", "left")
        .join(explained, "customer_id", "left")
        .join(made, "customer_id", "left")
        .join(valid, "customer_id", "left")
    )
    status = (
        F.when(F.col("has_profile").isNull(), "no_profile")
        .when(F.col("explanation_json").isNull(), "no_panel_row")
        .when(F.col("has_offer").isNull(), "no_valid_offer")
        .otherwise("succeeded")
    )
    return rows.select(
        "customer_id",
        "snapshot_date",
        "churn_probability",
        status.alias("status"),
        "attempts",
        F.when(F.col("has_profile"), F.col("explanation_json")).alias("explanation_json"),
        "discount_pct",
        "channel",
        "product_focus",
        "messaging",
    )
