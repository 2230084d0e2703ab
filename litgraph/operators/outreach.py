"""Author outreach and ingest scheduling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from litgraph.functions.text import emails
from litgraph.operators.joins import cap


def contacts(papers: DataFrame) -> DataFrame:
    """E-mail from metadata, else the given one; author given, else the last author."""
    found = F.try_element_at(emails(F.col("raw_metadata")), F.lit(1))
    given = F.col("contact_email") if "contact_email" in papers.columns else F.lit(None).cast("string")
    name = F.col("contact_name") if "contact_name" in papers.columns else F.lit(None).cast("string")
    return papers.withColumns({
        "to_email": F.coalesce(found, given),
        "to_name": F.coalesce(name, F.try_element_at("authors", F.lit(-1)))})


def outreach_eligibility(conns, papers, queued, sends, unsubs, now, min_confidence=0.7, cooldown_days=90) -> DataFrame:
    """Sure connections not queued before, each with the reason it may or may not be sent.

    ``papers`` carry ``to_email``. Addresses are compared lower-cased on both sides.
    """
    mail = lambda c: F.lower(F.trim(c))
    people = papers.select(F.col("paper_id").alias("paper_a_id"), F.col("title").alias("title_a"),
                           mail("to_email").alias("email"))
    others = papers.select(F.col("paper_id").alias("paper_b_id"), F.col("title").alias("title_b"))
    gone = unsubs.select(mail("email").alias("email")).distinct().withColumn("_gone", F.lit(True))
    recent = (
        sends.filter(F.col("sent_at") > F.lit(now).cast("timestamp") - F.expr(f"interval {int(cooldown_days)} days"))
        .select(mail("email").alias("email")).distinct().withColumn("_recent", F.lit(True))
    )
    # Each paper's address is judged once; papers without one take no part in the joins by address.
    has_mail = F.coalesce(F.length("email"), F.lit(0)) > 0
    people = people.filter(has_mail).join(gone, "email", "left").join(recent, "email", "left").unionByName(
        people.filter(~has_mail), allowMissingColumns=True)
    return (
        conns.filter(F.col("confidence") >= min_confidence)
        .join(queued.select("connection_id").distinct(), "connection_id", "left_anti")
        .join(people, "paper_a_id", "left").join(others, "paper_b_id", "left")
        .withColumn("reason",
            F.when(F.coalesce(F.length("title_a"), F.lit(0)) == 0, "paper a has no title")
            .when(F.coalesce(F.length("title_b"), F.lit(0)) == 0, "paper b has no title")
            .when(F.coalesce(F.length("email"), F.lit(0)) == 0, "no author email found")
            .when(F.col("_gone"), "unsubscribed")
            .when(F.col("_recent"), "90-day cooldown")
            .otherwise("eligible"))
        .select("connection_id", "paper_a_id", "paper_b_id", "email", "reason")
    )


VIEWS = {"pending": ("pending_draft", "drafted"), "drafts": ("drafted",), "ready": ("gmail_draft_created",)}


def outreach_view(queue: DataFrame, papers: DataFrame, view: str = "pending", limit: int = 20) -> DataFrame:
    """X11: newest queue items of a view, with both titles where known."""
    top = cap(queue.filter(F.col("status").isin(*VIEWS[view])), [F.desc("created_at"), F.asc("outreach_id")], limit)
    for s in ("a", "b"):
        top = top.join(papers.select(F.col("paper_id").alias(f"paper_{s}_id"), F.col("title").alias(f"paper_{s}_title")),
                       f"paper_{s}_id", "left")
    return top


def schedule(queries: DataFrame, total: int) -> DataFrame:
    """Limits of seed queries: core ring first, then priority, until the total is used up."""
    n = queries.count()
    each = max(total // max(n, 1), 10)
    order = [F.asc("ring"), F.desc("priority"), F.asc("query")]
    queries = cap(queries, order, -(-total // each))  # no others get a share, so the window below is as small
    place = F.row_number().over(Window.orderBy(*order))
    left = F.lit(total) - (place - 1) * each
    return queries.withColumn("position", place).withColumn(
        "query_limit", F.least(F.lit(each), left)).filter(F.col("query_limit") > 0)
