"""Intent queries: types, legacy buckets, templates, prompts, and a pluggable generator."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .text import col, cut_continuation, filled

# Query types and the bucket names that older files use for them.
BUCKETS = {
    "question": "Pragmatic",
    "paraphrase": "Subjective",
    "imperative": "Contextual",
    "negative": "Negative/Contrastive",
    "tagging": "Cross-domain",
}
TYPES = tuple(BUCKETS)
# Other names of generator backends.
BACKENDS = {"openai": "gpt", "chatgpt": "gpt", "dummy": "template", "mock": "template"}
# The sentence of each query type, with {c} for the caption and {n} for the hard negative.
TEMPLATES = {
    "question": "Can you find audio of {c}?",
    "imperative": "Find audio of {c}",
    "paraphrase": "Audio featuring {c}",
    "tagging": "Tagged audio of {c}",
    "negative": "Find audio of {c}, not {n}",
}


def query_type(text: Column | str) -> Column:
    """A known type in any case and with spaces around it, or a legacy bucket name; null otherwise."""
    t = F.trim(col(text))
    buckets = F.create_map(*[F.lit(x) for k, b in BUCKETS.items() for x in (b, k)])
    return F.coalesce(F.try_element_at(buckets, t), F.when(F.lower(t).isin(*TYPES), F.lower(t)))


def bucket(kind: Column | str) -> Column:
    """The legacy bucket of a query type."""
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in BUCKETS.items() for x in kv]), col(kind))


def backend(name: str) -> str:
    n = name.lower().strip()
    return BACKENDS.get(n, n)


def _bare(c: Column) -> Column:
    return F.regexp_replace(F.trim(c), r"\.+$", "")


def template_query(kind: Column | str, caption: Column | str, negative: Column | str | None = None) -> Column:
    """The template's query; a negative one without a hard negative, and an unknown type, give an empty text."""
    c = _bare(col(caption))
    n = _bare(col(negative)) if negative is not None else F.lit(None).cast("string")
    out = F.lit("")
    for k, t in TEMPLATES.items():
        made = F.replace(F.replace(F.lit(t), F.lit("{c}"), c), F.lit("{n}"), n) if "{n}" in t else F.replace(F.lit(t), F.lit("{c}"), c)
        out = F.when(col(kind) == k, F.coalesce(made, F.lit(""))).otherwise(out)
    return F.when(filled(caption), out).otherwise(F.lit(""))


def render(template: str, **values: Column | str) -> Column:
    """A prompt template with its {names} filled; nulls as empty texts."""
    out = F.lit(template)
    for k, v in values.items():
        out = F.replace(out, F.lit("{" + k + "}"), F.coalesce(col(v), F.lit("")))
    return out


def few_shot(task: Column | str, examples: Column | str, question: Column | str, head: str = "Examples:", pattern: str = "- {query} => {answer}") -> Column:
    """A prompt with worked examples (ARRAY of structs with query and answer) between the task and the question.

    Without examples the block is left out.
    """
    lines = F.transform(col(examples), lambda e: F.replace(F.replace(F.lit(pattern), F.lit("{query}"), F.coalesce(e["query"], F.lit(""))), F.lit("{answer}"), F.coalesce(e["answer"].cast("string"), F.lit(""))))
    block = F.when(F.coalesce(F.size(col(examples)), F.lit(0)) > 0, F.concat(F.lit(head), F.lit("\n"), F.array_join(lines, "\n")))
    return F.concat_ws("\n\n", col(task), block, col(question))


def first_seen(df: DataFrame, by: str, value: str, order: str) -> DataFrame:
    """`by`, values: the distinct values of each group, in the order in which they are first seen; null and blank ones fall away."""
    first = df.where(filled(value)).groupBy(by, value).agg(F.min(order).alias("_o"))
    item = F.struct("_o", F.col(value).alias("v"))
    return first.groupBy(by).agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["v"]).alias("values"))


def generate(rows: DataFrame, backend_fn: Callable[[list[str]], list[str]], prompt: str = "prompt") -> DataFrame:
    """`rows` with query and error, by a backend that answers a batch of prompts.

    The backend runs on executors, one call per Arrow batch; if a batch fails, its prompts are asked singly, and a
    prompt that fails gives an empty query and the error's text. No row is lost.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("query", T.StringType()), T.StructField("error", T.StringType())])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            asked = batch[prompt].tolist()
            try:
                batch["query"], batch["error"] = backend_fn(asked), None
            except Exception:
                queries, errors = [], []
                for p in asked:
                    try:
                        queries.append(backend_fn([p])[0])
                        errors.append(None)
                    except Exception as e:
                        queries.append("")
                        errors.append(str(e))
                batch["query"], batch["error"] = queries, errors
            yield batch

    out = rows.mapInPandas(make, schema)
    return out.withColumn("query", cut_continuation("query"))


def grouped(queries: DataFrame) -> DataFrame:
    """clip_id, source_captions, uiq: the non-empty queries of each clip, in the order of types and queries.

    `queries` has clip_id, original_caption, query_type and query.
    """
    kept = queries.where(filled("query"))
    item = F.struct(F.col("query_type"), F.col("query"), bucket("query_type").alias("bucket"))
    caption = F.when(filled("original_caption"), F.col("original_caption"))
    return kept.groupBy("clip_id").agg(F.array_sort(F.collect_set(caption)).alias("source_captions"), F.array_sort(F.collect_list(item)).alias("uiq"))


def counts(queries: DataFrame) -> DataFrame:
    """query_type, total, filled: rows and non-empty queries of each type."""
    return queries.groupBy("query_type").agg(F.count("*").alias("total"), F.count_if(filled("query")).alias("filled"))
