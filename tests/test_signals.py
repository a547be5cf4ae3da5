"""Signals and frames against numpy and by hand."""

import numpy as np
import pytest

from spanloom.operators import signals as sg


def sound(spark, *xs):
    return spark.createDataFrame([(c, i, float(v)) for c, x in enumerate(xs) for i, v in enumerate(x)], "clip long, i long, x double")


def test_offset_equals_a_full_correlation(spark):
    g = np.random.default_rng(3)
    scans = [g.normal(size=n).clip(-1, 1) for n in (700, 401, 130)]
    probes = [0.5 * s[a : a + m] + 0.1 * g.normal(size=m) for s, a, m in zip(scans, (333, 0, 65), (150, 401, 65))]
    for r in sg.offsets(sound(spark, *scans), sound(spark, *probes)).collect():
        a, b = scans[r["clip"]], probes[r["clip"]]
        c = np.correlate(a / (abs(a).max() + 1e-9), b / (abs(b).max() + 1e-9), "valid")
        k = int(abs(c).argmax())
        assert r["lag"] == k
        assert r["peak"] == pytest.approx(c[k])
        assert r["confidence"] == pytest.approx(abs(c[k]) / (np.sort(abs(c))[::-1][len(c) // 2] + 1e-9))


def test_a_probe_longer_than_the_scan_has_no_place(spark):
    assert sg.offsets(sound(spark, np.ones(10)), sound(spark, np.ones(11))).collect() == []


def test_loudness_equals_numpy(spark):
    g = np.random.default_rng(1)
    xs = [g.normal(size=n) * 0.1 for n in (1234, 25, 24)]
    got = {}
    for r in sg.loudness(sound(spark, *xs), 1000).orderBy("clip", "f").collect():
        got.setdefault(r["clip"], []).append((r["f"], r["at"], r["db"]))
    assert set(got) == {0, 1}
    for c, rows in got.items():
        x = xs[c]
        want = [(k, k * 0.01, 10 * np.log10((x[10 * k : 10 * k + 25] ** 2).mean() + 1e-12)) for k in range((len(x) - 25) // 10 + 1)]
        assert np.allclose(rows, want)


def test_spectrum_equals_numpy(spark):
    x = np.random.default_rng(2).normal(size=450)
    got = {(r["block"], r["hz"]): r["power"] for r in sg.power_spectrum(sound(spark, x), 200, 5, 90).collect()}
    assert {b for b, _ in got} == {0, 1}
    hann = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(200) / 200)
    for b in (0, 1):
        p = abs(np.fft.rfft(x[200 * b : 200 * b + 200] * hann)) ** 2 / 200**2
        assert np.allclose([got[b, h] for h in range(5, 91)], p[5:91])


def test_hum_is_found_on_the_grid_only(spark):
    g = np.random.default_rng(4)
    t = np.arange(4000) / 1000
    noise = lambda: g.normal(size=4000) * 0.05
    xs = [noise() + 0.1 * np.sin(2 * np.pi * 50 * t) + 0.08 * np.sin(2 * np.pi * 100 * t), noise() + 0.1 * np.sin(2 * np.pi * 54 * t), noise(), noise() + 0.3 * np.sin(2 * np.pi * 60 * t)]
    bad = {}
    for r in sg.hum(sound(spark, *xs), 1000).filter("level <> 'pass'").collect():
        bad.setdefault(r["clip"], set()).add(r["hz"])
    assert bad == {0: {50, 100}, 3: {60}}


def test_a_block_is_one_row_and_stands_out_as_by_numpy(spark):
    x = np.random.default_rng(6).normal(size=2300)
    powers = sg.block_powers(sound(spark, x, np.zeros(1000)), 1000, 12, 500).persist()
    got = {(r["clip"], r["block"]): np.array(r["powers"]) for r in powers.collect()}
    assert set(got) == {(0, 0), (0, 1), (1, 0)} and all(len(p) == 489 for p in got.values()) and not got[1, 0].any()
    for r in sg.around(powers, 12, [(50, 50), (60, 420)]).collect():
        p = dict(zip(range(12, 501), got[r["clip"], r["block"]]))
        band = sum(p[r["at"] + d] for d in range(-2, 3))
        floor = np.median([p[r["at"] + d] for d in range(-35, 36) if abs(d) >= 6])
        peak = max(range(-3, 4), key=lambda d: (p[r["at"] + d], -d))
        assert (r["peak"], r["at"]) == (peak, 50 if r["base"] == 50 else 420)
        assert np.isclose(r["band"], band) and np.isclose(r["prominence"], 10 * np.log10(band / (floor * 5 + 1e-18) + 1e-12))


def checks(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["clip"], {})[r["check"]] = (r["level"], r["measure"])
    return out


def test_audio_checks_by_hand(spark):
    g = np.random.default_rng(5)
    voice = g.normal(size=6000) * 0.2
    railed = voice.copy()
    railed[1000:1030] = 1.0  # 23 windows of eight
    late = voice.copy()
    late[:400], late[5400:] = 0.0, 0.0
    loud = voice.copy()
    loud[3000:] *= 5
    words = spark.createDataFrame([(0, 5, 0.1), (1, 5, 0.1), (2, 5, 0.1), (3, 5, 0.5)], "clip long, size int, seconds double")
    got = checks(sg.audio_checks(sound(spark, voice, railed, late, loud), 1000, words, window=1.0))
    assert got[1]["railed"] == ("error", pytest.approx(23 / 6000)) and got[0]["railed"] == ("pass", 0.0)
    assert got[0]["open"][0] == got[0]["close"][0] == "pass"
    assert got[2]["open"] == ("error", pytest.approx(0.38, abs=0.03)) and got[2]["close"] == ("warn", pytest.approx(0.6, abs=0.03))
    assert got[0]["last word"][0] == "error" and got[2]["last word"][0] == "pass" and got[3]["last word"][0] == "pass"
    assert got[0]["level"][0] == "pass" and got[3]["level"][0] == "error"


def test_bed_and_levels(spark):
    g = np.random.default_rng(6)
    x = np.concatenate([g.normal(size=2000) * 0.2, g.normal(size=1000) * 0.01, g.normal(size=3000) * 0.2])
    words = spark.createDataFrame([], "clip long, size int, seconds double")
    got = checks(sg.audio_checks(sound(spark, x), 1000, words))
    assert got[0]["bed"] == ("pass", pytest.approx(26, abs=1.5))
    peak = {k: v for k, v in checks(sg.level_checks(sound(spark, [0.5, -0.2], [0.999], [0.1, 0.1]), 1000)).items()}
    assert [peak[k]["peak"][0] for k in range(3)] == ["pass", "error", "error"]
    assert [peak[k]["clipping"][0] for k in range(3)] == ["pass", "error", "pass"]


def test_voice_opens_high_and_closes_low(spark):
    x = np.concatenate([np.full(300, 0.001), np.full(300, 0.5), np.full(100, 0.08), np.full(300, 0.001)])
    (r,) = sg.voiced_spans(sg.loudness(sound(spark, x), 1000)).collect()
    assert (r["st"], r["en"]) == (pytest.approx(0.28, abs=0.011), pytest.approx(0.715, abs=0.02))  # 0.08 is 16 dB under, between both levels


def test_picture_checks_by_hand(spark):
    def clip(c, n=60, **change):
        rows = []
        for k in range(n):
            r = {"light": 50.0, "diff": 2.0, "dx": 0.0, "dy": 0.1, "zoom": False, "cx": 0.5} | change.get(f"k{k}", {})
            rows.append((c, k, k / 5, *r.values()))
        return rows

    step, frozen = {"dy": 1.3}, {f"k{k}": {"diff": 0.1} for k in (20, 21, 22)}
    rows = clip(0) + clip(1, k30=step) + clip(2, k30=step | {"zoom": True}) + clip(3, k30={"dy": 1.3}, k31={"dy": -1.3}) + clip(4, k31={"dy": 2.0}) + clip(5, **frozen, k40={"dx": 9.0}) + clip(6, k0={"light": 1.0}, k59={"cx": None}) + clip(7, **{f"k{k}": {"cx": 0.1} for k in range(10, 19)})
    frames = spark.createDataFrame(rows, "clip long, f long, at double, light double, diff double, dx double, dy double, zoom boolean, cx double")
    seams = spark.createDataFrame([(4, 6.1, False), (0, 6.1, False)], "clip long, seam double, content boolean")
    got = checks(sg.picture_checks(frames, seams, 5.0))
    bad = {c: {k: v[0] for k, v in x.items() if v[0] != "pass"} for c, x in got.items()}
    assert bad == {0: {}, 1: {"shift": "error"}, 2: {}, 3: {"shift": "warn"}, 4: {"seam": "error"}, 5: {"frozen": "error", "pan": "error"}, 6: {"black": "error", "first and last": "error"}, 7: {"off centre": "warn"}}
