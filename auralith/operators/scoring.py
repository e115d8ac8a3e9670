"""Distributed batch scoring (M1/M2) and log-mel features (M3).

A predictor is any object with ``__call__(pdf: pandas.DataFrame) -> pandas.Series``; a factory builds it once per
task (a model would be loaded once per executor task, not per row) and it is applied to Arrow record batches by
``mapInPandas``. Outputs travel with their row's id columns (never attached by position across tables), so retries,
speculative tasks and any partitioning give the same table.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T

PredictorFactory = Callable[[], Callable[[pd.DataFrame], pd.Series]]


def score(df: DataFrame, keys: list[str], inputs: list[str], out: str, factory: PredictorFactory,
          out_type: T.DataType = T.StringType()) -> DataFrame:
    """M1: one output column from a predictor over ``inputs``; returns ``keys + [out]``."""
    src = df.select(*keys, *[c for c in inputs if c not in keys])
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField(out, out_type, True)])

    def run(batches):
        predict = factory()
        for pdf in batches:
            res = pdf[keys].copy()
            res[out] = predict(pdf) if len(pdf) else pd.Series([], dtype=object)
            yield res

    return src.mapInPandas(run, schema)


def score_heads(df: DataFrame, keys: list[str], heads: dict[str, tuple[list[str], PredictorFactory]],
                carry: list[str] | None = None) -> DataFrame:
    """M1 v3: several (inputs, predictor) heads in one Arrow pass; every predictor is built once per task.

    Rows come back one-for-one with their inputs, so the ``keys`` and ``carry`` columns travel with the batch and
    no join (and no shuffle) is needed to attach the outputs. Keep heavy columns a predictor does not read (audio
    bytes) out of ``carry`` and join them back by ``keys`` afterwards if they are needed."""
    carry = [c for c in (carry or []) if c not in keys]
    inputs = sorted({c for cols, _ in heads.values() for c in cols} - set(keys) - set(carry))
    src = df.select(*keys, *carry, *inputs)
    fields = [src.schema[c] for c in keys + carry] + [T.StructField(h, T.StringType(), True) for h in heads]
    schema = T.StructType(fields)
    names = list(heads)

    def run(batches):
        predictors = {h: f() for h, (_, f) in heads.items()}
        for pdf in batches:
            res = pdf[keys + carry].copy()
            for h in names:
                res[h] = predictors[h](pdf) if len(pdf) else pd.Series([], dtype=object)
            yield res

    return src.mapInPandas(run, schema)


def cascade(df: DataFrame, keys: list[str], inputs: list[str], asr: PredictorFactory, translate: PredictorFactory,
            asr_col: str = "text_asr", out_col: str = "text") -> DataFrame:
    """M2: transcribe, then translate the transcript; both stages stay in one Arrow pass per batch."""
    src = df.select(*keys, *[c for c in inputs if c not in keys])
    schema = T.StructType([src.schema[k] for k in keys] + [T.StructField(out_col, T.StringType()), T.StructField(asr_col, T.StringType())])

    def run(batches):
        first, second = asr(), translate()
        for pdf in batches:
            res = pdf[keys].copy()
            res[asr_col] = first(pdf) if len(pdf) else pd.Series([], dtype=object)
            res[out_col] = second(res.rename(columns={asr_col: "text"})) if len(pdf) else pd.Series([], dtype=object)
            yield res[keys + [out_col, asr_col]]

    return src.mapInPandas(run, schema)


# ---- test predictors (deterministic) --------------------------------------------------------------------------
def corrupting_predictor(text: str = "reference_raw", doc: str = "doc_id", line: str = "line_no"):
    """The deterministic 'ASR model' of the tests: same rules as ``auralith.plans.derived.corrupt_line``."""

    def predict(pdf: pd.DataFrame) -> pd.Series:
        out = []
        for t, d, n in zip(pdf[text], pdf[doc], pdf[line]):
            words = []
            for i, w in enumerate(t.split(" "), 1):
                if (i + d) % 11 == 0:
                    continue
                if (i + d) % 7 == 0:
                    words.append("zz")
                elif (i + n) % 13 == 0:
                    words.append(w + " " + w)
                else:
                    words.append(w)
            out.append(" ".join(words))
        return pd.Series(out, index=pdf.index, dtype=object)

    return predict


def reversing_translator(text: str = "text"):
    """The deterministic 'translation model' of the tests: word order reversed."""

    def predict(pdf: pd.DataFrame) -> pd.Series:
        return pdf[text].map(lambda s: " ".join(reversed(s.split(" "))))

    return predict


# ---- M3: log-mel features ------------------------------------------------------------------------------------------
def mel_filterbank(n_fft: int, n_mels: int, rate: float) -> np.ndarray:
    """Triangular filters evenly spaced on the mel scale ``2595 * log10(1 + f / 700)``, shape (n_mels, n_fft//2+1)."""
    bins = n_fft // 2 + 1
    freqs = np.linspace(0.0, rate / 2.0, bins)
    to_mel = lambda f: 2595.0 * np.log10(1.0 + f / 700.0)
    from_mel = lambda m: 700.0 * (10.0 ** (m / 2595.0) - 1.0)
    pts = from_mel(np.linspace(to_mel(0.0), to_mel(rate / 2.0), n_mels + 2))
    fb = np.zeros((n_mels, bins))
    for m in range(n_mels):
        lo, mid, hi = pts[m], pts[m + 1], pts[m + 2]
        up = (freqs - lo) / max(mid - lo, 1e-12)
        down = (hi - freqs) / max(hi - mid, 1e-12)
        fb[m] = np.maximum(0.0, np.minimum(up, down))
    return fb


def log_mel_batch(waves: list[np.ndarray], n_fft: int, hop: int, fb: np.ndarray) -> list[list[list[float]]]:
    """Hann-windowed STFT power -> mel -> log10 clamp to (max - 8) -> (x + 4) / 4, per waveform (frames x mels).
    Waveforms of equal length are stacked and transformed together."""
    out: list = [None] * len(waves)
    window = np.hanning(n_fft + 1)[:-1]
    by_len: dict[int, list[int]] = {}
    for i, w in enumerate(waves):
        by_len.setdefault(len(w), []).append(i)
    for n, idx in by_len.items():
        if n < n_fft:
            for i in idx:
                out[i] = []
            continue
        x = np.stack([np.asarray(waves[i], dtype=np.float64) for i in idx])
        n_frames = 1 + (n - n_fft) // hop
        frames = np.lib.stride_tricks.sliding_window_view(x, n_fft, axis=1)[:, ::hop][:, :n_frames]
        power = np.abs(np.fft.rfft(frames * window, axis=-1)) ** 2
        mel = power @ fb.T
        logm = np.log10(np.maximum(mel, 1e-10))
        logm = np.maximum(logm, logm.max(axis=(1, 2), keepdims=True) - 8.0)
        feats = ((logm + 4.0) / 4.0).astype(np.float32)
        for j, i in enumerate(idx):
            out[i] = feats[j].tolist()
    return out


def log_mel(df: DataFrame, keys: list[str], samples: str, rate: int, n_fft: int, hop: int, n_mels: int) -> DataFrame:
    """M3: ``keys + [input_features ARRAY<ARRAY<FLOAT>>]``; run it after every filter (Catalyst cannot push a
    predicate through ``mapInPandas``)."""
    src = df.select(*keys, samples)
    schema = T.StructType([src.schema[k] for k in keys] + [
        T.StructField("input_features", T.ArrayType(T.ArrayType(T.FloatType())), True)])
    fb = mel_filterbank(n_fft, n_mels, float(rate))

    def run(batches):
        for pdf in batches:
            res = pdf[keys].copy()
            res["input_features"] = log_mel_batch([np.asarray(w) for w in pdf[samples]], n_fft, hop, fb)
            yield res

    return src.mapInPandas(run, schema)
