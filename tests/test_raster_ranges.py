"""Files read by byte ranges against the arrays that were written."""

import math

import numpy as np
import pytest

from planeweave.sources import raster_files, raster_ranges


def card(k, v):
    return f"{k:<8}= {v:>20}".ljust(80).encode()


def fits(path, units):
    out = b""
    for i, (a, more) in enumerate(units):
        bitpix = {">i2": 16, ">f4": -32, "|u1": 8}[a.dtype.str]
        head = [card("SIMPLE", "T") if i == 0 else card("XTENSION", "'IMAGE   '"), card("BITPIX", bitpix), card("NAXIS", a.ndim),
                *[card(f"NAXIS{k + 1}", n) for k, n in enumerate(a.shape[::-1])], *[card(k, v) for k, v in more.items()], b"END".ljust(80)]
        head = b"".join(head)
        data = a.tobytes()
        out += head.ljust(-(-len(head) // 2880) * 2880) + data.ljust(-(-len(data) // 2880) * 2880, b"\0")
    path.write_bytes(out)


def grids(tiles):
    out = {}
    for t in tiles.collect():
        key = (t.image_id.rsplit("/", 1)[-1], t.page, t.channel)
        for i, v in enumerate(t.data):
            out.setdefault(key, {})[t.y0 + i // t.w, t.x0 + i % t.w] = v
    full = {}
    for k, v in out.items():
        g = np.full((max(y for y, _ in v) + 1, max(x for _, x in v) + 1), np.nan)
        for (y, x), value in v.items():
            g[y, x] = value
        assert len(v) == g.size
        full[k] = g
    return full


@pytest.mark.parametrize("strip", [1, 8 << 20])
def test_every_channel_slice_and_member_comes_back(spark, tmp_path, monkeypatch, strip):
    monkeypatch.setattr(raster_ranges, "STRIP_BYTES", strip)
    dice = np.random.default_rng(5)
    six = dice.normal(0, 1, (11, 13, 6)).astype("<f4")
    two = dice.integers(0, 60000, (7, 9, 2)).astype(">u2")
    fortran = np.asfortranarray(dice.integers(-99, 99, (10, 12, 3)).astype("<i2"))
    np.save(tmp_path / "six.npy", six)
    np.save(tmp_path / "two.npy", two)
    np.save(tmp_path / "fortran.npy", fortran)
    np.save(tmp_path / "flags.npy", two[..., 0] > 30000)
    np.savez(tmp_path / "plain.npz", a=six[..., 0], b=fortran)
    np.savez_compressed(tmp_path / "packed.npz", a=six, b=fortran)
    cube = dice.integers(-100, 100, (2, 3, 8, 10)).astype(">i2")
    flat = dice.normal(0, 1, (6, 5)).astype(">f4")
    fits(tmp_path / "cube.fits", [(cube, {"BSCALE": 0.5, "BZERO": 3, "BLANK": 7}), (flat, {})])
    (tmp_path / "c.pfm").write_bytes(b"PF\n13 11\n-1.0\n" + six[::-1, :, :3].tobytes())
    (tmp_path / "g.pgm").write_bytes(b"P5 # x\n9 7\n65535\n" + two[..., 0].tobytes())
    (tmp_path / "t.pgm").write_bytes(b"P2\n2 2\n9\n1 2 3 4\n")
    bits = dice.integers(0, 2, (5, 11)).astype(np.uint8)
    (tmp_path / "b.pbm").write_bytes(b"P4\n11 5\n" + np.packbits(bits, axis=1).tobytes())
    tiles, heads, bad = raster_ranges.ingest(spark, str(tmp_path), tile=4, tasks=5)
    got = grids(tiles)
    want = {("six.npy", 0, c): six[..., c] for c in range(6)} | {("two.npy", 0, c): two[..., c] for c in range(2)}
    want |= {(f, 0, c): fortran[..., c] for f in ("fortran.npy", "plain.npz#b.npy", "packed.npz#b.npy") for c in range(3)}
    want |= {("flags.npy", 0, 0): two[..., 0] > 30000, ("plain.npz#a.npy", 0, 0): six[..., 0]} | {("packed.npz#a.npy", 0, c): six[..., c] for c in range(6)}
    for i, s in enumerate(cube.reshape(6, 8, 10)):
        v = 3 + 0.5 * s.astype(float)
        v[s == 7] = np.nan
        want["cube.fits", i, 0] = v[::-1]
    want["cube.fits", 6, 0] = flat[::-1]
    want |= {("c.pfm", 0, c): six[..., c] for c in range(3)} | {("g.pgm", 0, 0): two[..., 0], ("b.pbm", 0, 0): (1 - bits) * 255, ("t.pgm", 0, 0): np.array([[1, 2], [3, 4]])}
    assert got.keys() == want.keys()
    for k in want:
        np.testing.assert_array_equal(got[k], np.asarray(want[k], float).astype(np.float32), err_msg=str(k))
    assert bad.count() == 0
    h = {r.image_id.rsplit("/", 1)[-1]: r for r in heads.where("page = 0").collect()}
    assert h["six.npy"].channels == 6 and h["cube.fits"].type_max == 3 + 0.5 * 32767 and h["two.npy"].numeric_type == "uint16" and heads.where("image_id like '%cube.fits'").count() == 7


def test_bad_files_are_named_and_the_rest_is_read(spark, tmp_path):
    a = np.ones((5, 6))
    np.save(tmp_path / "good.npy", a)
    (tmp_path / "cut.npy").write_bytes((tmp_path / "good.npy").read_bytes()[:-8])
    np.save(tmp_path / "four.npy", np.ones((2, 2, 2, 2)))
    np.save(tmp_path / "none.npy", np.ones((0, 3)))
    (tmp_path / "x.fits").write_bytes(b"SIMPLE".ljust(80))
    (tmp_path / "z.npz").write_bytes(b"PK no zip")
    (tmp_path / "p.pgm").write_bytes(b"P5 4 4 255\n123")
    tiles, heads, bad = raster_ranges.ingest(spark, str(tmp_path), tasks=2)
    assert {r.path.rsplit("/", 1)[-1] for r in bad.collect()} == {"cut.npy", "four.npy", "none.npy", "x.fits", "z.npz", "p.pgm"}
    assert tiles.count() == 1 and heads.count() == 1


def test_no_task_reads_more_than_its_strip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(raster_ranges, "STRIP_BYTES", 32 * 32 * 8)
    np.save(tmp_path / "big.npy", np.arange(200 * 300, dtype=float).reshape(200, 300))
    plan = raster_ranges.plan_planes(raster_ranges.list_files(spark, str(tmp_path)).drop("length"))
    rows = raster_ranges.strips(plan, tile=32).collect()
    assert len(rows) == math.ceil(200 / 32) * math.ceil(300 / 32) and max(r.lines * r.columns * 8 for r in rows) <= 32 * 32 * 8


def test_whole_file_decoding_keeps_all_channels(spark, tmp_path):
    six = np.arange(3 * 4 * 6, dtype=np.float32).reshape(3, 4, 6)
    np.save(tmp_path / "six.npy", six)
    t, planes, _ = raster_files.ingest(raster_files.read_files(spark, str(tmp_path)))
    assert sorted(r.channel for r in t.collect()) == list(range(6)) and planes.first().channels == 6
