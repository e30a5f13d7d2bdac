"""Context assembly: token budget, greedy packing of ranked claims, rendering, stage trace."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as tx

RESERVE, MARGIN, FINAL, RECENT = 0.25, 0.10, 10, 3
OVERHEAD_TOKENS = 200
EMPTY_NOTE = "No relevant context retrieved."
LAYOUTS = ("tagged", "list", "headings", "numbered", "plain")


def budget(window: Column, reserve: Column, question: Column, overhead: int = OVERHEAD_TOKENS, margin: float = MARGIN) -> Column:
    """Tokens left for claims; not positive means that the window is too small."""
    kept = F.coalesce(reserve, F.floor(window * RESERVE).cast("int"))
    return (window - kept - tx.estimate_tokens(question) - overhead - F.floor(window * margin)).cast("int")


def largest_reservation(window: Column, reserve: Column, question: Column, overhead: int = OVERHEAD_TOKENS, margin: float = MARGIN) -> Column:
    parts = {"output_reserve": F.coalesce(reserve, F.floor(window * RESERVE).cast("int")), "query_tokens": tx.estimate_tokens(question), "template_overhead": F.lit(overhead), "safety_margin": F.floor(window * margin).cast("int")}
    best = F.lit(None).cast("string")
    top = F.greatest(*parts.values())
    for name, value in reversed(parts.items()):
        best = F.when(value == top, F.lit(name)).otherwise(best)
    return best


def packed(ranked: DataFrame, budgets: DataFrame, claims: DataFrame, final: int = FINAL, recent: int = RECENT) -> DataFrame:
    """(qid, budget_total, budget_remaining, selected, dropped): a fold over each question's candidates.

    Candidates are the best ``final``, the pinned and the newest ``recent`` (those two protected, placed
    first); each is placed whole, else by its medium, else by its short summary, else dropped. Last, the
    unpinned are cut to ``final``. At most final + recent + pinned rows a question are collected.
    """
    info = claims.select(F.col("id").alias("claim_id"), "content", "summary_medium", "summary_short", "source", "entity", "attribute", "pinned")
    rows = ranked.join(info, "claim_id")
    rows = rows.withColumn("by_score", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("final_score"), "claim_id"))).withColumn("by_time", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("ts"), "claim_id")))
    safe = F.col("pinned") | (F.col("by_time") <= recent)
    rows = rows.withColumn("safe", safe).filter(safe | (F.col("by_score") <= final))
    item = F.struct((~F.col("safe")).alias("later"), "by_score", "claim_id", "pinned", "final_score", "source", "entity", "attribute", "content", "summary_medium", "summary_short")
    state = "struct<left:int,picked:array<struct<by_score:int,claim_id:bigint,pinned:boolean,mode:string,text:string,source:string,entity:string,attribute:string>>,dropped:array<bigint>>"
    grouped = rows.groupBy("qid").agg(F.array_sort(F.collect_list(item)).alias("items")).join(budgets.select("qid", "budget_total"), "qid")

    def place(s: Column, x: Column) -> Column:
        fits = lambda c: c.isNotNull() & (tx.estimate_tokens(c) <= s["left"])
        mode = F.when(fits(x["content"]), "full").when(fits(x["summary_medium"]), "medium").when(fits(x["summary_short"]), "short")
        text = F.when(mode == "full", x["content"]).when(mode == "medium", x["summary_medium"]).otherwise(x["summary_short"])
        picked = F.array(F.struct(x["by_score"].alias("by_score"), x["claim_id"].alias("claim_id"), x["pinned"].alias("pinned"), mode.alias("mode"), text.alias("text"), x["source"].alias("source"), x["entity"].alias("entity"), x["attribute"].alias("attribute")))
        yes = F.struct((s["left"] - tx.estimate_tokens(text)).alias("left"), F.concat(s["picked"], picked).alias("picked"), s["dropped"].alias("dropped"))
        no = F.struct(s["left"].alias("left"), s["picked"].alias("picked"), F.concat(s["dropped"], F.array(x["claim_id"])).alias("dropped"))
        return F.when(mode.isNotNull(), yes.cast(state)).otherwise(no.cast(state))

    empty = F.struct(F.col("budget_total").alias("left"), F.from_json(F.lit("[]"), "array<struct<by_score:int,claim_id:bigint,pinned:boolean,mode:string,text:string,source:string,entity:string,attribute:string>>").alias("picked"), F.array().cast("array<bigint>").alias("dropped")).cast(state)
    out = grouped.withColumn("s", F.aggregate("items", empty, place))
    pinned = F.size(F.filter("s.picked", lambda p: p["pinned"]))
    picked = F.array_sort("s.picked")
    free = F.filter(picked, lambda p: ~p["pinned"])
    keep = F.greatest(F.lit(0), final - pinned)
    selected = F.when(F.size(picked) > final, F.array_sort(F.concat(F.filter(picked, lambda p: p["pinned"]), F.slice(free, F.lit(1), keep)))).otherwise(picked)
    cut = F.when(F.size(picked) > final, F.transform(F.slice(free, keep + 1, F.lit(1 << 20)), lambda p: p["claim_id"])).otherwise(F.array().cast("array<bigint>"))
    return out.select("qid", "budget_total", F.col("s.left").alias("budget_remaining"), selected.alias("selected"), F.concat("s.dropped", cut).alias("dropped"))


def rendered(selected: Column, layout: Column) -> Column:
    """The selected claims in one of five layouts, or a note that there are none."""
    about = lambda p: F.when(p["entity"].isNotNull(), F.concat(F.lit(" ("), p["entity"], F.coalesce(F.concat(F.lit(": "), p["attribute"]), F.lit("")), F.lit(")"))).otherwise("")
    number = lambda i: (i + 1).cast("string")
    tagged = lambda p, i: F.concat(F.lit('<memory id="'), p["claim_id"].cast("string"), F.lit('" source="'), p["source"], F.lit('"'), F.coalesce(F.concat(F.lit(' entity="'), p["entity"], F.lit('"')), F.lit("")), F.lit(">\n"), p["text"], F.lit("\n</memory>"))
    ways = {
        "tagged": F.concat(F.lit("<context>\n"), F.array_join(F.transform(selected, tagged), "\n"), F.lit("\n</context>")),
        "list": F.concat(F.lit("## Memories\n"), F.array_join(F.transform(selected, lambda p: F.concat(F.lit("- "), p["text"])), "\n")),
        "headings": F.concat(F.lit("# Retrieved Context\n"), F.array_join(F.transform(selected, lambda p, i: F.concat(F.lit("### "), number(i), F.lit(". "), p["source"], F.lit("\n"), p["text"])), "\n\n")),
        "numbered": F.concat(F.lit("### Context\n"), F.array_join(F.transform(selected, lambda p, i: F.concat(F.lit("["), number(i), F.lit("] "), p["source"], about(p), F.lit("\n"), p["text"])), "\n\n")),
        "plain": F.concat(F.lit("## Context\n"), F.array_join(F.transform(selected, lambda p: F.concat(F.lit("- **"), p["source"], F.lit("**"), about(p), F.lit(": "), p["text"])), "\n")),
    }
    out = F.lit(None).cast("string")
    for name, text in ways.items():
        out = F.when(layout == name, text).otherwise(out)
    return F.when(F.coalesce(F.size(selected), F.lit(0)) == 0, F.lit(EMPTY_NOTE)).otherwise(out)


def assembled(questions: DataFrame, ranked: DataFrame, claims: DataFrame) -> DataFrame:
    """questions (qid, text, context_window, output_reserve, layout) with their packed and rendered context; a window that is too small gives an error instead."""
    asked = questions.withColumn("budget_total", budget(F.col("context_window"), F.col("output_reserve"), F.col("text"))).withColumn("error", F.when(F.col("budget_total") <= 0, largest_reservation(F.col("context_window"), F.col("output_reserve"), F.col("text"))))
    rows = packed(ranked, asked.filter("error is null"), claims)
    out = asked.join(rows.drop("budget_total"), "qid", "left")
    return out.select("qid", "layout", "budget_total", "error", F.coalesce("budget_remaining", "budget_total").alias("budget_remaining"), F.coalesce(F.size("selected"), F.lit(0)).alias("n_selected"), F.coalesce("dropped", F.array().cast("array<bigint>")).alias("dropped"), "selected", rendered(F.col("selected"), F.col("layout")).alias("rendered"))


def trace(**stages: DataFrame) -> DataFrame:
    """(qid, stage, n): rows of each question after each stage."""
    out = None
    for name, rows in stages.items():
        one = rows.groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.lit(name).alias("stage"), "n")
        out = one if out is None else out.unionByName(one)
    return out
