"""Table schemas of clips and their sample blocks."""

from __future__ import annotations

BLOCK = 32768
#: Blocks of a clip that one task measures together.
STRETCH = 16

CLIP = "clip_id string, path string, container string, codec string, sample_rate int, channels int, frames long, duration double, source_bytes long"
BLOCKS = "clip_id string, channel int, block_idx int, start long, samples array<float>"
LOUDNESS = "clip_id string, integrated double, range double, true_peak double, peak double, momentary array<double>, momentary_step double"
KEY = "clip_id string, tonic int, mode string, name string, camelot string, score double, runner_up string, confidence double, chroma array<double>"
TEMPO = "clip_id string, bpm double, confidence double, beat_period double, beat_offset double"
