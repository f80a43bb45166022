"""Deterministic stand-ins for models that a user would supply."""

from __future__ import annotations

import hashlib
from typing import Any

import pandas as pd


class DigestModel:
    """Scores a row by a digest of its id and refuses batches whose smallest id is 3 modulo 7."""

    def predict_batch(self, batch: pd.DataFrame, adapter: str | None = None) -> list[dict[str, Any]]:
        if batch["row_id"].min() % 7 == 3:
            raise RuntimeError("unusable batch")
        out = []
        for row_id in batch["row_id"]:
            text = str(row_id) if adapter is None else f"{row_id}|{adapter}"
            p = int(hashlib.md5(text.encode()).hexdigest()[:4], 16) / 65535
            out.append(
                {
                    "prediction": "Yes" if p > 0.5 else "No",
                    "is_violation": p > 0.5,
                    "violation_probability": p,
                    "confidence": max(p, 1 - p),
                }
            )
        return out


def length_generator():
    """Answers by prompt length; some prompts get no answer and some an error."""

    def generate(prompts: list[str]) -> list[Any]:
        out: list[Any] = []
        for prompt in prompts:
            n = len(prompt)
            if n % 13 == 0:
                out.append(RuntimeError("quota exceeded"))
            elif n % 11 == 0:
                out.append(None)
            else:
                out.append(f"Formatted Rule: {n}\nViolates Rule: {'Yes' if n % 2 else 'No'}")
        return out

    return generate
