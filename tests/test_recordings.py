"""Camera recordings: files written here by the formats' rules are read back whole."""

import struct

import numpy as np
import pytest

from chronoweave.sources import recordings, tables


def nmnist_file(events):
    return b"".join(bytes([x, y, p << 7 | t >> 16, t >> 8 & 255, t & 255]) for x, y, p, t in events)


def packet(kind, events, size=8, overflow=0):
    head = struct.pack("<hhiiiiii", kind, 1, size, 4, overflow, len(events), len(events), len(events))
    return head + b"".join(struct.pack("<Ii", valid | p << 1 | y << 2 | x << 17, t) for x, y, p, t, valid in events)


def aedat(*packets):
    return b"#!AER-DAT3.1\r\n#Format: RAW\r\n#!END-HEADER\r\n" + b"".join(packets)


def test_nmnist(spark, tmp_path):
    rng = np.random.default_rng(1)
    want = []
    for split, digit, name in (("Train", 3, "00001"), ("Train", 3, "00002"), ("Train", 7, "00003"), ("Test", 0, "00001")):
        folder = tmp_path / split / str(digit)
        folder.mkdir(parents=True, exist_ok=True)
        events = [(int(rng.integers(34)), int(rng.integers(34)), int(rng.integers(2)), int(t)) for t in sorted(rng.integers(0, 1 << 23, 50))]
        (folder / f"{name}.bin").write_bytes(nmnist_file(events))
        if split == "Train":
            want += [(f"{digit}/{name}", digit, (y * 34 + x) * 2 + p, t, x, y, p) for x, y, p, t in events]
    (tmp_path / "Train" / "7" / "00004.bin").write_bytes(b"")
    got = recordings.read_nmnist(spark, str(tmp_path), "train")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    one = recordings.read_nmnist(spark, str(tmp_path), "train", "3/00002")
    assert {r.item for r in one.collect()} == {"3/00002"} and one.count() == 50
    assert recordings.read_nmnist(spark, str(tmp_path), "test").count() == 50
    (tmp_path / "Train" / "7" / "00005.bin").write_bytes(b"1234567")
    with pytest.raises(Exception, match="7/00005"):
        recordings.read_nmnist(spark, str(tmp_path), "train").count()
    assert recordings.read_nmnist(spark, str(tmp_path), "train", skip_damaged=True).count() == 150
    with pytest.raises(ValueError):
        recordings.read_nmnist(spark, str(tmp_path), "valid")


def test_gestures(spark, tmp_path):
    special = struct.pack("<hhiiiiii", 0, 1, 8, 4, 0, 1, 1, 1) + b"\x00" * 8
    one = aedat(packet(1, [(127, 0, 1, 100, 1), (5, 6, 0, 150, 1), (9, 9, 1, 160, 0)]), special, packet(1, [(1, 2, 1, 199, 1), (1, 2, 1, 200, 1), (3, 4, 0, 900, 1)]), packet(1, []))
    (tmp_path / "user01_led.aedat").write_bytes(one)
    (tmp_path / "user01_led_labels.csv").write_text("class,startTime_usec,endTime_usec\n8,200,1000\n2,100,200\n")
    (tmp_path / "user02_led.aedat").write_bytes(aedat(packet(1, [(0, 0, 0, 5, 1)], overflow=1)))
    (tmp_path / "user02_led_labels.csv").write_text(f"class,startTime_usec,endTime_usec\n1,{1 << 31},{(1 << 31) + 10}\n")
    (tmp_path / "trials_to_train.txt").write_text("user01_led.aedat\n\n")
    (tmp_path / "trials_to_test.txt").write_text("user02_led.aedat\n")
    number = lambda x, y, p: (y * 128 + x) * 2 + p
    got = sorted(map(tuple, recordings.read_gestures(spark, str(tmp_path), "train").collect()))
    assert got == sorted([
        ("user01_led/0", 2, number(127, 0, 1), 0, 127, 0, 1),
        ("user01_led/0", 2, number(5, 6, 0), 50, 5, 6, 0),
        ("user01_led/0", 2, number(1, 2, 1), 99, 1, 2, 1),
        ("user01_led/1", 8, number(1, 2, 1), 0, 1, 2, 1),
        ("user01_led/1", 8, number(3, 4, 0), 700, 3, 4, 0),
    ])
    assert {r.item for r in recordings.read_gestures(spark, str(tmp_path), "train", "user01_led/1").collect()} == {"user01_led/1"}
    assert [(r.item, r.t) for r in recordings.read_gestures(spark, str(tmp_path), "test").collect()] == [("user02_led/0", 5)]
    (tmp_path / "user01_led.aedat").write_bytes(one[:-3])
    with pytest.raises(Exception, match="user01_led"):
        recordings.read_gestures(spark, str(tmp_path), "train").count()


@pytest.mark.parametrize("raw", [b"#no end", aedat(b"abc"), aedat(packet(1, [(1, 1, 1, 1, 1)])[:-1]), aedat(packet(1, [(1, 1, 1, 1, 1)], size=4))])
def test_damaged_files_are_told(raw):
    with pytest.raises(ValueError):
        recordings.gesture_events(raw)


def test_tables_of_recordings(spark, tmp_path):
    folder = tmp_path / "raw" / "Train" / "4"
    folder.mkdir(parents=True)
    (folder / "1.bin").write_bytes(nmnist_file([(1, 2, 1, 5), (3, 4, 0, 9)]))
    for _ in range(2):
        recordings.to_table(recordings.read_nmnist(spark, str(tmp_path / "raw"), "train"), str(tmp_path / "table"), "train")
    got = tables.read_dataset(spark, str(tmp_path / "table"), "train", "4/1")
    assert sorted(map(tuple, got.collect())) == [("4/1", 4, 139, 5), ("4/1", 4, 278, 9)]
