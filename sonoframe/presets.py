"""Named effects: settings of equalizers, spaces, echoes, voices and speeds, and what they do to an AudioFrame."""

from __future__ import annotations

import math

from sonoframe.frame import AudioFrame

# Fixed values: (kind, Hz, quality) of the bands of the graphic equalizer, and the gains of its presets in dB.
BANDS = [("lowshelf", 60, 0.7), ("peaking", 150, 1.1), ("peaking", 400, 1.1), ("peaking", 1000, 1.1), ("peaking", 2400, 1.1), ("peaking", 6000, 1.1), ("peaking", 12000, 1.1), ("highshelf", 16000, 0.7)]
GAINS = {
    "flat": (0, 0, 0, 0, 0, 0, 0, 0),
    "voice": (-3, -1, 0, 2, 4, 3, 0, -2),
    "music": (4, 2, -1, -1, 0, 2, 3, 2),
    "bass": (9, 6, 2, 0, 0, 0, 0, 0),
    "treble": (0, 0, 0, 0, 2, 5, 7, 6),
    "podcast": (-12, -6, -1, 1, 3, 2, -2, -5),
    "radio": (-10, -4, 2, 5, 6, 3, -6, -12),
}
# Fixed values: (decay in seconds, mix, pre-delay in seconds) of spaces, and (delay in seconds, feedback, mix) of echoes.
SPACES = {"room": (0.6, 0.20, 0.008), "studio": (1.2, 0.26, 0.018), "hall": (2.5, 0.35, 0.035), "cathedral": (5.0, 0.45, 0.060), "canyon": (8.0, 0.55, 0.120)}
ECHOES = {"slapback": (0.08, 0.12, 0.35), "classic": (0.35, 0.40, 0.40), "dub": (0.60, 0.75, 0.50)}
# Fixed values: (semitones, lowest and highest Hz, whether length follows pitch) of voices.
VOICES = {
    "deeper": (-4.0, 50, 12000, False),
    "higher": (4.0, 50, 12000, False),
    "chipmunk": (12 * math.log2(1.5), 50, 12000, True),
    "giant": (12 * math.log2(0.7), 50, 12000, True),
    "robot": (0.0, 50, 3200, False),
    "telephone": (0.0, 300, 3400, False),
    "radio": (0.0, 200, 5200, False),
    "none": (0.0, 50, 12000, False),
}


def bass(f: AudioFrame, db: float, corner: float = 100.0, fit: bool = False) -> AudioFrame:
    """A low shelf; `fit` brings the peak to -1 dB."""
    out = f.equalize([("lowshelf", corner, db, 0.7)]) if db > 0 else f
    return out.normalize_peak(-1.0) if fit else out


def treble(f: AudioFrame, db: float) -> AudioFrame:
    return f.equalize([("highshelf", 6000, db, 0.7)])


def telephone(f: AudioFrame) -> AudioFrame:
    return f.equalize([("highpass", 300, 0.0, 0.9), ("lowpass", 3400, 0.0, 0.9), ("peaking", 1800, 6.0, 1.4)])


def graphic(f: AudioFrame, preset: str) -> AudioFrame:
    return f.equalize([(kind, hz, float(db), q) for (kind, hz, q), db in zip(BANDS, GAINS[preset])])


def space(f: AudioFrame, name: str) -> AudioFrame:
    decay, mix, lead = SPACES[name]
    return f.reverb(decay, lead, mix)


def echo(f: AudioFrame, name: str) -> AudioFrame:
    return f.echo(*ECHOES[name])


def audible_repeats(feedback: float) -> int:
    """Repeats of an echo over a twentieth of the sound."""
    return max(0, math.floor(math.log(0.05) / math.log(feedback))) if feedback > 0.01 else 0


def voice(f: AudioFrame, name: str) -> AudioFrame:
    semitones, low, high, follows = VOICES[name]
    if follows:
        f = f.change_speed(2 ** (semitones / 12))
    elif semitones:
        f = f.pitch_shift(semitones)
    f = f.equalize([("highpass", low, 0.0, 0.707), ("lowpass", high, 0.0, 0.707)] + ([("peaking", 2200, 6.0, 1.0)] if name == "radio" else []))
    return f.echo(0.018, 0.5, 0.5) if name == "robot" else f


def nightcore(f: AudioFrame, speed: float = 1.25) -> AudioFrame:
    return f.change_speed(min(1.45, max(1.15, speed)))


def slowed(f: AudioFrame, speed: float = 0.85, mix: float = 0.34, decay: float = 2.9) -> AudioFrame:
    """Slower first, then in a room."""
    return f.change_speed(min(1.0, max(0.7, speed))).reverb(min(6.0, max(0.5, decay)), 0.03, min(0.8, max(0.0, mix)))
