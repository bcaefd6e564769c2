"""Where a caller's model comes in: embeddings of images, texts from images."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

_loaded: dict = {}

EMBEDDED = "features array<array<double>>, attention array<double>, cls array<double>, grid_size int"


def with_model(df: DataFrame, name: str, load: Callable[[], object], apply: Callable[[object, pd.DataFrame], pd.DataFrame], added: str) -> DataFrame:
    """``df`` with columns that a model gives; each worker loads it once under ``name``.

    ``apply`` gets the model and a batch and returns the added columns.
    """

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if name not in _loaded:
            _loaded[name] = load()
        for part in parts:
            yield pd.concat([part.reset_index(drop=True), apply(_loaded[name], part).reset_index(drop=True)], axis=1)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{schema}, {added}")


def embed(frames: DataFrame, name: str, load, extract) -> DataFrame:
    """Frames with features (a row a patch), attention, cls and grid_size; the image is dropped.

    ``extract`` turns the model and a batch of images into the four values of each.
    """
    apply = lambda model, part: pd.DataFrame(list(extract(model, part)), columns=["features", "attention", "cls", "grid_size"])
    return with_model(frames, name, load, apply, EMBEDDED).drop("image")


def generate(prompts: DataFrame, name: str, load, answer) -> DataFrame:
    """Rows (prompt, and what else the model needs) with its response; ``answer`` gives those of a batch."""
    apply = lambda model, part: pd.DataFrame({"response": list(answer(model, part))})
    return with_model(prompts, name, load, apply, "response string")


def description_settings(generation: dict) -> dict:
    """Careful decoding for descriptions: at least 400 tokens, no sampling, no penalties."""
    return {**generation, "max_new_tokens": max(400, int(generation.get("max_new_tokens", 300))), "do_sample": False, "repetition_penalty": 1.0, "no_repeat_ngram_size": 0}


def model_settings(config: dict) -> dict:
    """Defaults of a model's configuration; keys of ``max_memory`` that are digits are device numbers."""
    memory = config.get("max_memory") or {}
    keyed = {int(k) if str(k).isdigit() else k: v for k, v in memory.items()}
    return {"dtype": "bfloat16", "device_map": "auto", **config, "max_memory": keyed or None}
