"""Sinks: tables that replace what they cover, JSON lines, failure lists and documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Writes Parquet, replacing only the partitions that df has."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def json_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def failures(df: DataFrame, path: str) -> None:
    df.select("source_id", "reason").write.mode("overwrite").option("sep", "\t").csv(path)


def vectors(df: DataFrame, path: str, model: str) -> None:
    """Vectors with the name of their model; rows of that model are replaced."""
    replace_partitions(df.withColumn("model", F.lit(model)), path, "model")


def missing_vectors(items: DataFrame, held: DataFrame, key: str, model: str) -> DataFrame:
    """Items without a vector of this model: what a build has to encode when it goes on. Vectors of another model don't count, so a change of model starts anew. held: key, model."""
    return items.join(held.where(F.col("model") == model).select(key).distinct(), key, "left_anti")


def annotate(text: str, marks: list[tuple[int, str]]) -> str:
    """A brief with a mark behind each span end, put in from right to left."""
    for end, mark in sorted(marks, reverse=True):
        text = f"{text[:end]} {mark}{text[end:]}"
    return text


ROMAN = ((10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i"))


def roman(n: int) -> str:
    out = ""
    for value, letters in ROMAN:
        out, n = out + letters * (n // value), n % value
    return out


def blocks(plan: dict, points: list[dict]) -> list[tuple[str, str]]:
    """Kind and text of a draft's blocks in order: title, synopsis, dates, issues, submissions, prayer, authorities."""
    out = [("title", plan["headers"].get("title", "Written submissions"))]
    for name in ("synopsis", "dates"):
        if plan[name]:
            out += [("heading", name.capitalize())] + [("paragraph", x) for x in plan[name]]
    out += [("heading", "Issues")] + [("item", f"({roman(k)}) {i['title']}") for k, i in enumerate(plan["issues"], 1)]
    out.append(("heading", "Submissions"))
    for k, p in enumerate(points, 1):
        cite = f" {p['citation']}, para {p['label']}." if p.get("citation") else " [no authority found]"
        out.append(("paragraph", f"{k}. {p['proposition'].rstrip('.')}.{cite}"))
    if plan["prayer"]:
        out += [("heading", "Prayer")] + [("paragraph", x) for x in plan["prayer"]]
    cited = sorted({p["citation"] for p in points if p.get("citation")})
    return out + ([("heading", "Table of authorities")] + [("item", c) for c in cited] if cited else [])


def markdown(parts: list[tuple[str, str]]) -> str:
    marks = {"title": "# ", "heading": "## ", "item": "- ", "paragraph": ""}
    return "\n\n".join(marks[k] + t for k, t in parts) + "\n"


def authorities_table(cites: DataFrame) -> DataFrame:
    """judgment, title, labels over cites (judgment, title, court_rank, decided, label): by court, date and title; labels by length, then text."""
    g = cites.groupBy("judgment", "title", "court_rank", "decided").agg(F.collect_set("label").alias("labels"))
    ordered = F.array_join(F.transform(F.array_sort(F.transform("labels", lambda x: F.struct(F.length(x), x.alias("label")))), lambda s: s["label"]), ", ")
    # Placed within its court, after all of the courts before it: a row a court knows how many those are.
    courts = g.groupBy(F.col("court_rank").alias("_court")).agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(F.lit(0)).orderBy("_court").rowsBetween(Window.unboundedPreceding, -1)
    courts = courts.select("_court", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("court_rank").orderBy("decided", "title", "judgment"))
    placed = g.withColumn("_own", own).join(courts, F.col("court_rank").eqNullSafe(F.col("_court")))
    return placed.select("judgment", "title", ordered.alias("labels"), (F.col("_own") + F.col("_before")).cast("int").alias("place"))
