"""The count-triggered grammar check as a stateful stream, one state per passage."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import median

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from textloom.operators.live import LiveConfig

OUT = "passage_id string, token_index long, n_words long, z double, alert boolean"
STATE = "recent array<string>, n long, history array<double>, late array<struct<token_index:long,words:array<string>,is_last:boolean>>, due long"


def robust_z(value: float, history: list[float]) -> float:
    if len(history) < 2:
        return 0.0
    middle = median(history)
    sigma = 1.4826 * median(abs(h - middle) for h in history)
    return 0.0 if sigma < 1e-6 else (value - middle) / sigma


def perplexity(window: list[str], counts: tuple[dict, dict], vocab: int, order: int, k: float) -> float:
    """Of a window under an add-k model of the order; counts are of n-grams and of their histories."""
    grams, histories = counts
    text = ["<s>"] * (order - 1) + window + ["</s>"]
    lp = 0.0
    for i in range(order - 1, len(text)):
        g = tuple(text[i - order + 1 : i + 1])
        lp += math.log((grams.get(g, 0) + k) / (histories.get(g[:-1], 0) + k * (vocab + 2)))
    return math.exp(-lp / (len(window) + 1)) if window else 0.0


def live_triggers(tokens: DataFrame, score, config: LiveConfig = LiveConfig()) -> DataFrame:
    """A row per fired trigger of a stream (passage_id, token_index, words, is_last).

    State per passage: the last words, their number, the perplexities so far (what the baseline needs), and tokens that
    came before their turn, which wait for it. A passage's state is dropped with the token marked is_last, before which
    the extra trigger for remaining words fires. ``score`` maps a window to its perplexity. Repeated tokens are ignored."""

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        recent, n, history, late, due = state.get if state.exists else ([], 0, [], [], 0)
        recent, history = list(recent), list(history)
        waiting = {r["token_index"] if isinstance(r, dict) else r[0]: (list(r["words"] if isinstance(r, dict) else r[1]), bool(r["is_last"] if isinstance(r, dict) else r[2])) for r in late}
        for part in parts:
            for r in part.itertuples():
                if r.token_index >= due:
                    waiting[int(r.token_index)] = (list(r.words), bool(r.is_last))
        out, over = [], False
        while due in waiting:
            words, last = waiting.pop(due)
            recent, n = (recent + words)[-config.every :], n + len(words)
            if len(recent) >= 2 and n and (n % config.every == 0 or last):
                pp = score(recent)
                z = robust_z(pp, history)
                out.append((key[0], due, n, z, len(history) >= config.warm_up and z >= config.z_threshold))
                history.append(pp)
            due += 1
            over |= last
        if over:
            state.remove()
        else:
            state.update((recent, n, history, [(i, w, l) for i, (w, l) in sorted(waiting.items())], due))
        yield pd.DataFrame(out, columns=["passage_id", "token_index", "n_words", "z", "alert"])

    return tokens.groupBy("passage_id").applyInPandasWithState(step, OUT, STATE, "append", GroupStateTimeout.NoTimeout)
