"""A generated corpus of invented agreements and engagement letters, with one question per chunk.

Names and amounts come from a keyed generator, chunks and questions from templates filled in Spark. Any two frames
with the same schemas can stand in for it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palimpsest.functions.keyed import key_of, uniform, whole
from palimpsest.functions.text import fill, money

CHUNKS = "id long, doc_id string, doc_title string, section string, text string"
QUESTIONS = "qid long, question string, answer string, gold_chunk_id long, family string"

PLACES = ("Alder", "Birch", "Cedar", "Dune", "Ember", "Fjord", "Garnet", "Heron", "Islet", "Juniper", "Kestrel", "Linden")
BORROWERS = [f"{p} {k}" for p, k in zip(PLACES, ("Foods", "Freight", "Glass", "Mills", "Steel", "Optics") * 2, strict=True)]
AGENTS = ["Northgate Trust", "Harbour Bank", "Meridian Credit"]
FIRMS = ["Quill & Stone", "Marlow Reed", "Ashdown Partners", "Tern Legal", "Vesper Chambers", "Oxbow Counsel"]
PARTNERS = ["R. Calloway", "M. Okafor", "S. Lindqvist", "T. Moreau", "J. Arroyo", "P. Novak", "H. Tanaka", "E. Brandt"]
MONTHS = ["January", "March", "May", "July", "September", "November"]

CREDIT = [
    ("Commitment", "{agent} undertakes to lend {borrower} up to {amount} in total. Drawings must be asked for in writing before noon.", "How much may {borrower} borrow in total?", "{amount}"),
    ("Margin", "Interest accrues at the base rate plus {margin} percent a year. {borrower} pays it at the end of each quarter.", "What margin over the base rate does {borrower} pay?", "{margin}"),
    ("Maturity", "All sums that {borrower} owes fall due on the last day of {month} {year}. No extension is implied by this clause.", "When does the loan of {borrower} fall due?", "{month} {year}"),
    ("Covenant", "The leverage of {borrower} may not exceed {ratio} to one on any test date. {agent} tests it twice a year.", "What leverage may {borrower} not exceed?", "{ratio}"),
    ("Grace", "A payment of {borrower} is late once {days} business days have passed. Until then no default interest is charged.", "How many business days of grace does {borrower} have?", "{days} business days"),
    ("Notices", "Notices to {borrower} quote account {account} and go to the address in the first schedule. {agent} keeps copies.", "Which account do notices to {borrower} quote?", "{account}"),
    ("Fees", "{borrower} pays {agent} an arrangement fee of {fee} on signing. The fee is not refunded in any event.", "What arrangement fee does {borrower} pay?", "{fee}"),
]
LEGAL = [
    ("Scope", "{firm} advises {borrower} on file {file}. Tax questions are outside the scope of this letter.", "Which file of {borrower} does {firm} advise on?", "{file}"),
    ("Rates", "Time of {partner} is charged to {borrower} at {rate} an hour. {firm} reviews its rates every January.", "What does {firm} charge {borrower} for an hour of its partner?", "{rate}"),
    ("Retainer", "{borrower} places a retainer of {retainer} with {firm} before work begins. Unused sums go back to it.", "What retainer does {borrower} place with {firm}?", "{retainer}"),
    ("Closing", "{firm} may close the file of {borrower} after {weeks} weeks without instructions. {partner} gives notice first.", "After how many weeks may {firm} close the file of {borrower}?", "{weeks} weeks"),
]


def _pick(names: list[str], at):
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(at, F.lit(len(names))) + 1).cast("int"))


def _documents(spark: SparkSession, seed: int) -> DataFrame:
    """One row for each agreement and letter, with its values and templates."""
    draw = lambda k: uniform(key_of(F.lit(seed), F.col("doc_id")), F.lit(k))
    amount = lambda k, low, high, step: money(whole(draw(k), low // step, high // step) * step)
    i = F.col("i")
    credit = spark.range(len(BORROWERS)).select(F.col("id").alias("i")).select(
        F.lit("credit").alias("family"), i.alias("ord"), F.format_string("AG-%03d", i).alias("doc_id"), _pick(BORROWERS, i).alias("borrower"),
        _pick(AGENTS, i).alias("agent"), F.lit("").alias("firm"), F.lit("").alias("partner"), F.lit("Credit agreement").alias("kind"),
    )
    letters = spark.range(2 * len(FIRMS)).select(F.floor(F.col("id") / 2).alias("i"), (F.col("id") % 2).alias("j"), "id").select(
        F.lit("legal").alias("family"), (F.col("id") + len(BORROWERS)).alias("ord"), F.format_string("LT-%03d", F.col("id")).alias("doc_id"),
        _pick(BORROWERS, i * 2 + F.col("j")).alias("borrower"), F.lit("").alias("agent"), _pick(FIRMS, i).alias("firm"), _pick(PARTNERS, i * 2 + F.col("j")).alias("partner"), F.lit("Engagement letter").alias("kind"),
    )
    rows = credit.unionByName(letters)
    return rows.withColumns({
        "amount": amount(0, 2_000_000, 90_000_000, 500_000), "fee": amount(1, 10_000, 400_000, 2_500), "rate": amount(2, 250, 950, 25), "retainer": amount(3, 5_000, 60_000, 1_000),
        "margin": F.format_string("%.2f", whole(draw(4), 100, 525) / F.lit(100.0)), "ratio": F.format_string("%.1f", whole(draw(5), 20, 65) / F.lit(10.0)), "month": _pick(MONTHS, whole(draw(6), 0, 5)),
        "year": whole(draw(7), 2026, 2034).cast("string"), "days": whole(draw(8), 2, 15).cast("string"), "account": F.format_string("%04d-%d", whole(draw(9), 1000, 9999), whole(draw(10), 0, 9)),
        "file": F.format_string("F%05d", whole(draw(11), 10000, 99999)), "weeks": whole(draw(12), 3, 26).cast("string"),
    })


def generated(spark: SparkSession, seed: int = 1729) -> DataFrame:
    """Chunks and their questions side by side; ids run from 0 without gaps, agreements first."""
    rows = _documents(spark, seed)
    sections = [(f, k, *t) for f, group in (("credit", CREDIT), ("legal", LEGAL)) for k, t in enumerate(group)]
    templates = spark.createDataFrame(sections, "family string, place int, section string, body string, ask string, told string")
    names = ("borrower", "agent", "firm", "partner", "amount", "fee", "rate", "retainer", "margin", "ratio", "month", "year", "days", "account", "file", "weeks")
    values = {n: F.col(n) for n in names}
    both = rows.join(F.broadcast(templates), "family")
    number = F.when(F.col("family") == "credit", F.col("ord") * len(CREDIT) + F.col("place")).otherwise(len(BORROWERS) * len(CREDIT) + (F.col("ord") - len(BORROWERS)) * len(LEGAL) + F.col("place"))
    return both.select(
        number.cast("long").alias("id"), "doc_id", F.concat_ws(" ", "kind", "doc_id").alias("doc_title"), "section",
        fill(F.col("body"), values).alias("text"), fill(F.col("ask"), values).alias("question"), fill(F.col("told"), values).alias("answer"), "family",
    )


def chunks(spark: SparkSession, seed: int = 1729) -> DataFrame:
    return generated(spark, seed).select("id", "doc_id", "doc_title", "section", "text")


def questions(spark: SparkSession, seed: int = 1729) -> DataFrame:
    return generated(spark, seed).select(F.col("id").alias("qid"), "question", "answer", F.col("id").alias("gold_chunk_id"), "family")


def checked(rows: DataFrame, schema: str) -> DataFrame:
    """A frame of one's own as chunks or questions: columns by name and type, others dropped."""
    return rows.select(*[F.col(part.split()[0]).cast(part.split()[1]) for part in schema.split(", ")])
