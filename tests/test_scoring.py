"""Scoring (M1/M2) joined by id, and log-mel features (M3) against a direct per-row computation."""

import numpy as np

from auralith.operators import scoring as SC


def test_score_heads_join_by_id(spark):
    df = spark.createDataFrame([(1, 0, "a b c d e f g"), (2, 3, "x y")], "doc_id long, line_no long, reference_raw string")
    out = SC.score_heads(df.repartition(3), ["doc_id", "line_no"], {"hyp": (["reference_raw"], SC.corrupting_predictor)},
                         carry=["reference_raw"])
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()
    got = {r.doc_id: r.hyp for r in out.collect()}
    assert got == {1: "a b c d e zz g", 2: "x y"}
    c = SC.cascade(df, ["doc_id", "line_no"], ["reference_raw"], SC.corrupting_predictor, SC.reversing_translator)
    assert {r.doc_id: (r.text, r.text_asr) for r in c.collect()}[2] == ("y x", "x y")


def _direct(wave, n_fft, hop, fb):
    win = np.hanning(n_fft + 1)[:-1]
    frames = [wave[i:i + n_fft] for i in range(0, len(wave) - n_fft + 1, hop)]
    power = np.array([np.abs(np.fft.rfft(np.asarray(f, dtype=np.float64) * win)) ** 2 for f in frames])
    logm = np.log10(np.maximum(power @ fb.T, 1e-10))
    logm = np.maximum(logm, logm.max() - 8.0)
    return (logm + 4.0) / 4.0


def test_log_mel_matches_direct(spark):
    rng = np.random.default_rng(0)
    waves = [rng.standard_normal(64).astype(np.float32).tolist() for _ in range(5)] + [[0.5] * 40]
    df = spark.createDataFrame([(i, w) for i, w in enumerate(waves)], "vec_id long, embedding array<float>")
    out = {r.vec_id: np.array(r.input_features) for r in SC.log_mel(df, ["vec_id"], "embedding", 16, 16, 8, 4).collect()}
    fb = SC.mel_filterbank(16, 4, 16.0)
    for i, w in enumerate(waves):
        np.testing.assert_allclose(out[i], _direct(np.asarray(w, dtype=np.float32), 16, 8, fb), rtol=1e-5, atol=1e-5)
