"""Kernels and presets without SQL: muxing, separation, measures, named effects, and their queries."""

import io

import numpy as np
import pytest

from sonoframe import presets
from sonoframe.frame import AudioFrame
from sonoframe.kernels import classify, demix, mux
from sonoframe.plans import audio
from sonoframe.sources import headers


def test_muxed_packets_are_read_back():
    packets = [bytes([k]) * (50 + k) for k in range(200)]
    data = mux.mp4(packets, 44100, 2, frames=200 * 1024 - 1500, delay=1024)
    found = headers.inspect(data)
    assert (found["container"], found["rate"], found["channels"], found["audio_bytes"]) == ("mp4", 44100, 2, sum(map(len, packets)))
    assert found["seconds"] == pytest.approx(200 * 1024 / 44100, abs=0.05)
    assert headers.inspect_stream(io.BytesIO(data)) == found
    assert data.endswith(b"".join(packets))
    stream, at = mux.adts(packets, 44100, 2), 0
    for p in packets:
        head = int.from_bytes(stream[at : at + 7], "big")
        n = head >> 13 & 0x1FFF
        assert head >> 44 == 0xFFF and n == len(p) + 7 and stream[at + 7 : at + n] == p
        at += n


def test_index_behind_the_sound_is_found():
    data = mux.mp4([bytes(100)] * 10, 48000, 1)
    ftyp, moov = data[:28], data[28 : 28 + int.from_bytes(data[28:32], "big")]
    big = (300_000).to_bytes(4, "big") + b"mdat" + bytes(299_992)
    assert headers.inspect_stream(io.BytesIO(ftyp + big + moov))["audio_bytes"] == 1000
    tagged = b"ID3\x04\x00\x00" + bytes([0, 5, 0, 0]) + bytes(5 << 14) + b"fLaC" + bytes(4) + bytes(10) + (44100 << 12 | 1 << 9 | 15 << 4).to_bytes(4, "big")[:4] + bytes(20)
    assert headers.inspect_stream(io.BytesIO(tagged))["container"] == "flac"


def test_an_identity_model_gives_the_mix():
    rng = np.random.default_rng(3)
    t = np.arange(30_000) / 44100
    mix = np.stack([sum(np.sin(2 * np.pi * f * t) for f in (60, 110, 180, 250)), rng.normal(scale=0.01, size=len(t))])
    found = demix.demix(mix, lambda z: z, 2048, 512, 600, 33)
    noise = ((found[0] - mix[0]) ** 2).sum()
    assert found.shape == mix.shape and 10 * np.log10((mix[0] ** 2).sum() / noise) > 40
    assert demix.complement("vocals") == "instrumental" and demix.geometry(256, 33, 1024) == (8192, 512, 7168)
    delayed = {"last": np.zeros(480)}

    def late(f):
        out, delayed["last"] = delayed["last"], f
        return out

    assert np.allclose(demix.framed(mix[0][:5000], late), mix[0][:5000]) and not demix.framed(np.zeros(100), late).any()


def test_measures_part_notes_from_glides():
    rate = 16000
    t = np.arange(rate * 12) / rate
    steps = 220 * 2 ** (np.floor(t * 3) % 8 / 12)
    music = np.sin(2 * np.pi * np.cumsum(steps) / rate) * 0.4
    glide = 160 * 2 ** (0.4 * np.sin(2 * np.pi * 0.7 * t))
    speech = np.sin(2 * np.pi * np.cumsum(glide) / rate) * 0.4 * (0.5 + 0.5 * np.sin(2 * np.pi * 4 * t)) * (np.sin(2 * np.pi * 0.5 * t) > -0.3)
    a, b = classify.measure([music], rate), classify.measure([speech], rate)
    assert a["on_notes"] > b["on_notes"] and a["held"] > b["held"] and b["syllables"] > a["syllables"] and b["gaps"] > a["gaps"]
    assert a["correlation"] == 1.0 and classify.measure([np.zeros(rate)], rate)["on_notes"] is None


def test_presets(spark):
    rate = 8000
    x = (0.3 * np.sin(2 * np.pi * 200 * np.arange(rate) / rate)).astype(np.float32)
    f = AudioFrame.from_arrays(spark, {"a": (rate, [x, x])})
    level = lambda g: g.levels().collect()[0].rms
    assert level(presets.bass(f, 6.0, 300.0)) > level(f) and presets.bass(f, 6.0, fit=True).levels().collect()[0].peak == pytest.approx(10 ** (-1 / 20), rel=1e-3)
    assert level(presets.telephone(f)) < level(f) and level(presets.graphic(f, "flat")) == pytest.approx(level(f), rel=0.02)
    assert presets.nightcore(f).clips.collect()[0].frames == pytest.approx(rate / 1.25, abs=2)
    assert presets.voice(f, "giant").clips.collect()[0].frames > rate and presets.slowed(f).clips.collect()[0].frames > rate
    assert presets.echo(f, "classic").clips.collect()[0].frames > rate and presets.space(f, "room").clips.collect()[0].frames > rate
    assert presets.audible_repeats(0.4) == 3 and presets.audible_repeats(0.0) == 0
    assert set(presets.GAINS) >= {"flat", "voice", "bass"} and all(len(v) == len(presets.BANDS) for v in presets.GAINS.values())


@pytest.mark.parametrize("name", sorted(set(audio.QUERIES) - set(audio.ORACLES)))
def test_clip_queries(name, spark, sf_dir):
    rows = audio.QUERIES[name](spark, sf_dir).collect()
    assert len(rows) == 10
    if name == "clip_loudness":
        assert all(-30 < r.integrated < -5 and r.true_peak >= r.peak - 1e-6 for r in rows)
    if name == "clip_tempo":
        assert all(abs(r.bpm / (80 + int(r.clip_id[1:]) % 90) - 1) < 0.02 for r in rows)


def test_edits_on_frames(spark):
    rate = 1000
    tone = np.full(rate, 0.5, np.float32)
    gap = np.concatenate([tone, np.zeros(rate, np.float32), tone])
    f = AudioFrame.from_arrays(spark, {"a": (rate, [tone, tone / 2]), "b": (500, [tone[:500]]), "c": (rate, [gap])})

    def sound(g, clip="a"):
        rows = sorted((r.channel, r.block_idx, r.samples) for r in g.blocks.where(f"clip_id = '{clip}'").collect())
        return [np.concatenate([x for c, _, x in rows if c == k]) for k in sorted({r[0] for r in rows})]

    faded = sound(f.fade(0.1, 0.1))[0]
    assert faded[0] == 0 and faded[-1] == 0 and faded[500] == 0.5 and faded[50] == pytest.approx(0.25)
    assert len(sound(f.pad(0.1, 0.2))[0]) == 1300 and len(sound(f.loop(3, 0.1))[0]) == 3200 and len(sound(f.trim(), "c")[0]) == 3000
    assert [x[0] for x in sound(f.swap_channels())] == [0.25, 0.5] and len(sound(f.extract_channel(7))) == 1 and sound(f.set_channels(1))[0][0] == 0.375
    assert len(sound(f.cut_out(0.4, 0.6))[0]) == 800 - 10 and len(sound(f.remove_silence(), "c")[0]) == 3000 - (1000 - 160) - 5
    wide = sound(f.stereo_width(2.0))
    assert wide[0][0] == pytest.approx(0.625) and wide[1][0] == pytest.approx(0.125)
    order = spark.createDataFrame([("j", 1, "a"), ("j", 2, "b")], "joined string, position int, clip_id string")
    joined = f.concat(order, 0.1)
    row = joined.clips.collect()[0]
    assert (row.sample_rate, row.channels, row.frames) == (1000, 2, 1900)
    left = sound(joined, "j")[0]
    assert left[500] == 0.5 and left[950] == pytest.approx(0.5 * (np.cos(np.pi / 4) + np.sin(np.pi / 4)), rel=0.05)
