"""Prompt assembly, normative status and dialog context over retrieved chunks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

RULES = "Отвечай только по приведённым фрагментам и называй номер пункта."
#: Wording that makes a rule mandatory, or a recommendation (fixed values).
MANDATORY = r"(?iu)(должн|запреща|не допускается|необходимо|обязательн)"
RECOMMENDED = r"(?iu)(рекоменду|допускается|разрешается|может|могут|следует)"


def status_label(text: Column) -> Column:
    """mandatory, recommended or null; mandatory wording wins."""
    return F.when(F.regexp_like(text, F.lit(MANDATORY)), "mandatory").when(F.regexp_like(text, F.lit(RECOMMENDED)), "recommended")


def prompts(hits: DataFrame, questions: DataFrame, *, rules: str = RULES) -> DataFrame:
    """(query_id, prompt): rules, the hits of each query by rank with their clause, and the question."""
    line = F.concat(F.lit("Контекст из п. "), F.coalesce("clause", F.lit("–")), F.lit(': "'), F.col("text"), F.lit('"'))
    context = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("lines"))
    joined = F.array_join(F.transform("lines", lambda x: x.line), "\n")
    return questions.join(context, "query_id").select("query_id", F.concat_ws("\n", F.lit(rules), joined, F.concat(F.lit("Вопрос: "), F.col("question"))).alias("prompt"))


def answers(asked: DataFrame, make: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """(query_id, answer): prompts through a plugged-in generator; ``make`` builds it once per task. Off unless called."""

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for b in batches:
            yield pd.DataFrame({"query_id": b["query_id"], "answer": model(b["prompt"].tolist())})

    return asked.select("query_id", "prompt").mapInPandas(generate, "query_id BIGINT, answer STRING")


def prefixed(model: Column, text: Column, *, query: bool) -> Column:
    """Texts with the prefix their model family expects."""
    e5 = F.contains(F.lower(model), F.lit("e5"))
    bge = F.contains(F.lower(model), F.lit("bge"))
    ask = F.when(e5, "query: ").when(bge, "Represent this sentence for searching relevant passages: ").otherwise("")
    tell = F.when(e5, "passage: ").otherwise("")
    return F.concat(ask if query else tell, text)


def dialog_context(turns: DataFrame, n: int, *, user: str, at: str, turn: str, text: str) -> DataFrame:
    """(user, turn, history): each turn with the n turns before it, oldest first."""
    before = Window.partitionBy(user).orderBy(at, turn).rowsBetween(-n, -1)
    return turns.select(user, turn, F.array_join(F.collect_list(text).over(before), " | ").alias("history"))
