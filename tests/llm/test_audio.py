import hashlib
import io
import sys
import wave
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from cases import AWKWARD, EXTRA, SCHEMA, rows, widened

from treeloom.llm import audio


def test_round_trip_and_wave_library():
    for text in AWKWARD:
        x = audio.listen(text or "")
        data = (text or "").encode()
        payload = data + b" " * (-len(data) % 192 or (0 if data else 192))
        assert bytes(x.payload) == payload and x.n_bytes == len(data)
        with wave.open(io.BytesIO(x.media)) as w:
            assert (w.getnchannels(), w.getsampwidth(), w.getframerate()) == (1, 1, 16000) and w.readframes(10**9) == payload
    with pytest.raises(ValueError):
        audio.from_wave(b"RIFX" + bytes(40))


@pytest.mark.parametrize(("up", "down"), [(1, 2), (3, 4), (2, 1), (1, 1), (2, 3)])
def test_resampling_is_the_plain_one(up, down):
    x = np.random.default_rng(1).normal(size=192).astype(np.float32)
    got = audio.resampled(x, up, down)
    h = audio._filter(up, down, audio.TAPS)
    padded = np.concatenate([np.full(8, x[0]), x, np.full(40, x[-1])])
    want = [padded[k * down // up : k * down // up + 16] @ h[k * down % up][::-1] for k in range(-(-len(x) * up // down))]
    assert np.allclose(got, want, atol=1e-5)
    assert np.allclose(audio.resampled(np.full(192, 0.5, np.float32), up, down), 0.5, atol=1e-5)


def test_a_tone_lands_in_its_band_and_segments_follow_energy():
    t = np.arange(8000) / 8000
    mel, energy = audio.log_mel(np.sin(2 * np.pi * 1000 * t).astype(np.float32), 8000)
    weights = audio._mel_weights(8000, audio.WINDOW, audio.MELS)
    assert mel[5].argmax() == weights[32].argmax()
    level = np.array([0, 0, 10, 4, 2.1, 0, 0, 0, 9, 9, 0, 2.1], np.float32)
    level -= level.mean()
    state, runs = False, []
    for i, e in enumerate(level):
        now = e >= 3 or (state and e >= 1)
        if now and not state:
            runs.append([i, i])
        state = now
        if state:
            runs[-1][1] = i + 1
    assert audio.active(level).tolist() == runs


def test_tensors_have_a_fixed_shape():
    x = audio.listen("abc def " * 5000)
    back = pa.ipc.open_stream(audio.stored(audio.tensors(x))).read_all()
    assert isinstance(back.schema.field("mel").type, pa.FixedShapeTensorType) and back.schema.field("mel").type.shape == [32, 20]
    whole = np.concatenate([c.to_numpy_ndarray() for c in back["mel"].chunks]).reshape(-1, 20)
    assert (whole[: len(x.mel)] == x.mel).all() and back["start"][1].as_py() == pytest.approx(32 * 128 / 12000)
    mel, energy = audio.read_back(audio.stored(audio.tensors(x)))
    assert (mel == x.mel).all() and (energy == x.energy).all()
    assert back["end"][-1].as_py() == pytest.approx((len(x.mel) - 1) * 128 / 12000 + 256 / 12000)


def test_query(spark):
    some = rows(AWKWARD)
    for df in (spark.createDataFrame(some, SCHEMA), spark.createDataFrame(widened(some), EXTRA).repartition(3)):
        files = {r["doc_id"]: r for r in audio.columns(df).collect()}
        got = {r["doc_id"]: r for r in audio.digests(audio.columns(df)).collect()}
        assert len(got) == len(some)
        for doc_id, text, *_ in some:
            r, x = got[doc_id], audio.listen(text or "")
            payload = bytes(x.payload)
            assert (r["payload_sha256"], r["tail_crc32"], r["payload_bytes"]) == (hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(payload))
            assert (r["media_sha256"], r["media_bytes"], r["feature"]) == (hashlib.sha256(x.media).hexdigest(), len(payload) + 44, audio.feature(x.mel, x.energy, files[doc_id]["active"]))
    assert got[9]["feature"] == got[11]["feature"]
    assert {hashlib.sha256(r["media"]).hexdigest() for r in files.values()} == {r["media_sha256"] for r in got.values()}
    assert pa.ipc.open_stream(files[0]["features"]).read_all().num_rows >= 1
    assert audio.digests(audio.columns(df.limit(0))).count() == 0


def test_repeated_rows_and_rows_without_ids(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, None)], "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["n_bytes"], r["feature"]) for r in audio.digests(audio.columns(df)).collect())
    assert [g[:2] for g in got] == [(0, 0), (0, 3), (1, 3), (1, 3)] and len({g[2] for g in got[1:]}) == 1
