"""Plug-in points for a model and an engine; both run inside Arrow batches."""

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _called(call, n: int) -> list:
    """The results of one call for a batch of `n` rows; an error stands for the rows it hits.

    The callable may return an exception in place of a row's result. One that it raises, or a
    wrong number of results, counts for the whole batch.
    """
    try:
        results = list(call())
    except Exception as error:  # noqa: BLE001 - reported with each row
        return [error] * n
    if len(results) != n:
        return [ValueError(f"{len(results)} results for {n} rows")] * n
    return results


def _told(result) -> str | None:
    return f"{type(result).__name__}: {result}" if isinstance(result, Exception) else None


def batch_generate(prompts: DataFrame, n: int, generate, key="prompt_id", text="prompt") -> DataFrame:
    """(key, sample_idx, text, error): `n` samples per prompt.

    `generate(prompts, samples)` gets a whole batch as two lists and returns as many texts. A row
    that failed has a null text and the reason in `error`.
    """

    def run(batches):
        for batch in batches:
            given = batch["_prompt"].tolist(), batch["sample_idx"].tolist()
            results = _called(lambda: generate(*given), len(batch))
            texts = [None if isinstance(r, Exception) else r for r in results]
            errors = [_told(r) for r in results]
            yield pd.DataFrame(
                {key: batch[key], "sample_idx": batch["sample_idx"], "text": texts, "error": errors}
            )

    grid = prompts.select(key, F.col(text).alias("_prompt")).withColumn(
        "sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    )
    kind = dict(prompts.dtypes)[key]
    return grid.mapInPandas(run, f"{key} {kind}, sample_idx int, text string, error string")


def batch_candidates(positions: DataFrame, analyse, k=5) -> DataFrame:
    """(position, pv_rank, move, cp, error): up to `k` lines per position, best first.

    `analyse(positions, k)` gets a whole batch as a list and returns a list of (move, cp) for each.
    Positions must be unique, so that each is analysed once. A position that failed has one row
    with the reason in `error`.
    """

    def run(batches):
        for batch in batches:
            rows, given = [], batch["position"].tolist()
            for position, result in zip(given, _called(lambda: analyse(given, k), len(given))):
                if isinstance(result, Exception):
                    rows.append((position, None, None, None, _told(result)))
                    continue
                lines = enumerate(list(result)[:k])
                rows += [(position, i + 1, move, cp, None) for i, (move, cp) in lines]
            out = pd.DataFrame(rows, columns=["position", "pv_rank", "move", "cp", "error"])
            yield out.astype({"pv_rank": "Int32", "cp": "Int32"})

    kind = dict(positions.dtypes)["position"]
    return positions.select("position").mapInPandas(
        run, f"position {kind}, pv_rank int, move string, cp int, error string"
    )
