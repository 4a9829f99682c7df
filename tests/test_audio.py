"""Decoding, resampling, log-mel frames and scores drawn out of noise."""

from __future__ import annotations

import io
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from tonewell.operators import audio, matching, rerank


def wav(x: np.ndarray, rate: int, width: int = 2) -> bytes:
    """Samples (one row a frame, one column a channel) as a WAV file."""
    out = io.BytesIO()
    with wave.open(out, "wb") as f:
        f.setnchannels(x.shape[1])
        f.setsampwidth(width)
        f.setframerate(rate)
        whole = np.round(x * ((1 << 8 * width - 1) - 1)).astype(np.int64)
        f.writeframes(b"".join(int(v + (128 if width == 1 else 0)).to_bytes(width, "little", signed=width > 1) for v in whole.ravel()))
    return out.getvalue()


@pytest.mark.parametrize("width", [1, 2, 3, 4])
def test_pcm_of_every_width(width):
    x = np.array([[0.5, -0.5], [0.25, 0.25], [-1.0, 0.0]])
    got, rate = audio.pcm(wav(x, 8_000, width))
    assert rate == 8_000 and got == pytest.approx(x.mean(1), abs=0.02)
    assert audio.pcm(b"no audio") is None


def test_resampling_keeps_a_tone():
    t = np.arange(8_000) / 8_000
    got = audio.resampled(np.sin(2 * np.pi * 440 * t), 8_000, 16_000)
    want = np.sin(2 * np.pi * 440 * np.arange(16_000) / 16_000)
    assert len(got) == 16_000 and np.abs(got - want)[200:-200].max() < 0.01
    down = audio.resampled(np.sin(2 * np.pi * 3_500 * np.arange(16_000) / 16_000), 16_000, 4_000)
    assert np.abs(down)[200:-200].max() < 0.05  # above the new Nyquist frequency


def test_decode_fit_and_frames(spark):
    tone = 0.5 * np.sin(2 * np.pi * 1_000 * np.arange(16_000) / 16_000)[:, None]
    df = spark.createDataFrame([(1, bytearray(wav(tone, 16_000))), (2, bytearray(b"broken")), (3, None)], "id int, content binary")
    decoded = audio.decode(df)
    sizes = {r.id: (r.n, r.m) for r in decoded.select("id", F.size("samples").alias("n"), F.size(audio.fitted("samples", 20_000)).alias("m")).collect()}
    assert sizes[1] == (16_000, 20_000) and sizes[2][0] in (-1, None) and {r.id for r in decoded.where("samples is null").collect()} == {2, 3}
    rows = {r.id: r.frames for r in audio.log_mel(decoded).collect()}
    frames = np.array(rows[1])
    assert frames.shape == (101, 80) and rows[2] is None
    filters = audio.mel_filters(16_000, 400, 80, 50.0, 8_000.0)
    assert frames[50].argmax() == (filters[:, 25]).argmax()  # 1 kHz lies in bin 25
    made = audio.log_mel(decoded).where("id = 1").select(audio.chunks("frames", 40, 16).alias("c")).first().c
    assert [len(c) for c in made] == [40, 40, 32]


def test_centre_and_start_of_long_audio(spark):
    df = spark.createDataFrame([([float(i) for i in range(9)],)], "s array<float>")
    got = df.select(audio.fitted("s", 3).alias("a"), audio.fitted("s", 3, centre=False).alias("b"), audio.fitted("s", 11).alias("c")).first()
    assert list(got.a) == [3.0, 4.0, 5.0] and list(got.b) == [0.0, 1.0, 2.0] and list(got.c) == [*map(float, range(9)), 0.0, 0.0]


def test_scores_out_of_noise(spark):
    """A denoiser that knows the cosine gives the cosine, whatever the noise; one that keeps the noise depends on the row alone."""
    rows = [(q, d, [1.0, 0.0], [float(np.cos(d)), float(np.sin(d))]) for q in (1, 2) for d in range(5)] + [(1, 9, None, [1.0, 0.0])]
    c = spark.createDataFrame(rows, "q long, d long, a array<double>, b array<double>")
    alphas = np.cumprod([1 - b for b in matching.cosine_schedule(20)]).tolist()

    def exact():
        return lambda a, b, x, t: b @ a

    def lazy():
        return lambda a, b, x, t: x

    got = {(r.q, r.d): r.denoised for r in rerank.denoised_scores(c, "b", "a", exact, alphas, 5).collect()}
    assert set(got) == {(q, d) for q in (1, 2) for d in range(5)} and all(got[q, d] == pytest.approx(np.cos(d)) for q, d in got)
    one = {(r.q, r.d): r.denoised for r in rerank.denoised_scores(c, "b", "a", lazy, alphas, 5).collect()}
    two = {(r.q, r.d): r.denoised for r in rerank.denoised_scores(c.repartition(7), "b", "a", lazy, alphas, 5).collect()}
    assert one == two and len(set(one.values())) == 10
