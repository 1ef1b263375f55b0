import numpy as np
import pytest

from sonoframe.frame import AudioFrame, channels_of
from sonoframe.sources import wav


@pytest.fixture(scope="module")
def clips():
    rng = np.random.default_rng(4)
    t = np.arange(70000) / 22050
    return {"a": (22050, [(0.5 * np.sin(2 * np.pi * 220 * t)).astype(np.float32), (0.25 * rng.normal(size=70000)).astype(np.float32)]), "b": (8000, [np.linspace(-1, 1, 9000, dtype=np.float32)])}


@pytest.fixture(scope="module")
def frame(spark, clips):
    return AudioFrame.from_arrays(spark, clips)


def arrays(frame):
    import pyarrow as pa

    t = frame.blocks.toArrow()
    names = sorted(set(t.column("clip_id").to_pylist()))
    return {n: channels_of(t.filter(pa.compute.equal(t.column("clip_id"), n)).cast(pa.schema([("clip_id", pa.string()), ("channel", pa.int32()), ("block_idx", pa.int32()), ("start", pa.int64()), ("samples", pa.list_(pa.float32()))]))) for n in names}


def test_pointwise(frame, clips):
    assert np.allclose(arrays(frame.gain(-6.0))["a"][0], clips["a"][1][0] * 10 ** (-6 / 20), atol=1e-7)
    assert np.array_equal(arrays(frame.invert().invert())["b"][0], clips["b"][1][0])
    assert np.abs(np.concatenate(arrays(frame.normalize_peak(-1.0))["a"])).max() == pytest.approx(10 ** (-1 / 20), rel=1e-6)


def test_slice_and_reverse(frame, clips):
    cut = arrays(frame.slice(0.5, 2.5))
    assert np.array_equal(cut["a"][0], clips["a"][1][0][11025:55125])
    assert np.array_equal(cut["b"][0], clips["b"][1][0][4000:9000])
    back = arrays(frame.reverse())
    assert np.array_equal(back["a"][1], clips["a"][1][1][::-1]) and np.array_equal(arrays(frame.reverse().reverse())["a"][1], clips["a"][1][1])


def test_loudness_levels_and_keys(frame, clips):
    from sonoframe.kernels.loudness import measure

    found = {r.clip_id: r for r in frame.loudness().collect()}
    for name, (rate, x) in clips.items():
        assert found[name].integrated == pytest.approx(measure(x, rate)["integrated"])
    rms = {r.clip_id: r.rms for r in frame.levels().collect()}
    assert rms["b"] == pytest.approx(np.sqrt(np.mean(clips["b"][1][0].astype(float) ** 2)), rel=1e-6)
    assert {r.clip_id for r in frame.keys().collect()} == {"a", "b"}
    louder = {r.clip_id: r.integrated for r in frame.normalize_loudness(-40.0, 0.0).loudness().collect()}
    assert louder["b"] == pytest.approx(-40.0, abs=0.01)


def test_resample_and_equalize(frame):
    r = frame.resample(11025)
    assert {(c.clip_id, c.sample_rate, c.frames) for c in r.clips.collect()} == {("a", 11025, 35000), ("b", 11025, 12403)}
    assert frame.equalize([("peaking", 1000.0, 0.0, 1.0)]) is frame
    assert arrays(frame.equalize([("lowpass", 500.0, 0.0, 0.7)]))["a"][0].shape == (70000,)


@pytest.mark.parametrize("depth, error", [(16, 5e-5), (24, 2.5e-7), (32, 0.0)])
def test_wav_round_trip(spark, frame, clips, tmp_path, depth, error):
    wav.register(spark)
    only = frame.blocks.where("clip_id = 'a'").repartition(2, "clip_id")
    only.write.format("wav").option("rate", 22050).option("depth", depth).mode("append").save(str(tmp_path / "out"))
    read = spark.read.format("wav").option("framesPerPartition", 32768).load(str(tmp_path / "out"))
    meta = spark.read.format("wav").option("table", "clip").load(str(tmp_path / "out")).collect()
    assert [(m.clip_id, m.sample_rate, m.channels, m.frames) for m in meta] == [("a", 22050, 2, 70000)]
    got = arrays(AudioFrame(frame.clips, read))["a"]
    assert all(np.abs(g - np.clip(x, -1, 1) if depth != 32 else g - x).max() <= error for g, x in zip(got, clips["a"][1]))


def test_wav_headers_that_cannot_be_read(tmp_path):
    for k, data in enumerate((b"", b"RIFFxxxxWAVE", b"RIFF\0\0\0\0WAVEdata\0\0\0\0", wav.encode([np.zeros(4, np.float32)], 44100)[:30])):
        (tmp_path / f"{k}.wav").write_bytes(data)
        with open(tmp_path / f"{k}.wav", "rb") as f:
            assert wav.read_header(f) is None
    odd = wav.encode([np.zeros(4, np.float32)], 44100)
    (tmp_path / "junk.wav").write_bytes(odd[:12] + b"LIST\x03\x00\x00\x00abc\x00" + odd[12:])
    with open(tmp_path / "junk.wav", "rb") as f:
        assert wav.read_header(f).frames == 4


def test_generated_blocks_are_not_broadcast(spark, sf_dir):
    """Spark takes blocks that a task generates for as small as the rows they come from; they must not pass through the driver."""
    from sonoframe.plans import audio

    made = audio.clips(spark, sf_dir)
    dealt = AudioFrame(made.clips, made.blocks)
    assert made.blocks.rdd.getNumPartitions() > 1 or made.clips.count() <= 1
    for f in (made, dealt):
        found = [f.keys(), f.resample(11025).clips, f.loudness()]
        assert not any("BroadcastHashJoin" in df._jdf.queryExecution().executedPlan().toString() for df in found[:2])
    few = [AudioFrame(f.clips.where("clip_id IN ('s1', 's2', 's3')"), f.blocks.where("clip_id IN ('s1', 's2', 's3')"), f.rate) for f in (made, dealt)]
    got = [{r.clip_id: (r.integrated, r.true_peak) for r in f.loudness().collect()} for f in few]
    assert got[0].keys() == got[1].keys() and all(got[0][k] == pytest.approx(got[1][k]) for k in got[0])
    keys = [sorted((r.clip_id, r.name) for r in f.keys().collect()) for f in few]
    assert keys[0] == keys[1] and keys[0]


@pytest.mark.parametrize("name", ["clip_kinds", "clip_tempo", "identity_demix", "spectrum_shares", "resampled", "stem_levels", "stft_round_trip", "stretched", "true_peaks"])
def test_queries_of_clips_broadcast_nothing(spark, sf_dir, name):
    from sonoframe.plans import audio

    assert "Broadcast" not in audio.QUERIES[name](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_a_clip_is_measured_once(monkeypatch):
    """For clip_kinds: ten measures of a clip come from one reading of it."""
    from sonoframe.kernels import classify
    from sonoframe.plans import audio

    calls, kernels = [], []
    monkeypatch.setattr(classify, "measure", lambda xs, r: calls.append(r) or dict.fromkeys(("syllables", "gaps", "consonants", "voiced", "voiced_frames", "on_notes", "held", "beat", "bass", "correlation"), 0.5))
    monkeypatch.setattr(audio, "clips", lambda *_: None)
    monkeypatch.setattr(audio, "_each", lambda _, names, f: kernels.append(f))
    monkeypatch.setattr(audio.votes, "classify", lambda _: None)
    audio.clip_kinds(None, None)
    assert kernels[0]([np.zeros(8)], 8000) == [0.5] * 10 and calls == [8000]
