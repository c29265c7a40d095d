import threading
import time

import numpy as np

from spokeflow.sources import readers
from spokeflow.streaming import device, live


def film(path, numbers):
    path.mkdir(exist_ok=True)
    for k in numbers:
        np.save(path / "half.tmp.npz.npy", np.full((2, 3), k * 256.0))
        (path / "half.tmp.npz.npy").rename(path / device.frame_name(k))


def frames_of(publisher):
    return sorted(r.frame for r in readers.frame_messages(publisher.messages()).select("frame").collect())


def test_a_publisher_stops_while_frames_keep_coming(spark, tmp_path):
    place, going, sent = tmp_path / "device", threading.Event(), []

    def camera():
        while not going.is_set():
            film(place, [len(sent)])
            sent.append(1)
            time.sleep(0.002)

    film(place, range(5))
    sent += [1] * 5
    thread = threading.Thread(target=camera)
    thread.start()
    path = f"file://{place}"
    try:
        publisher = live.Publisher(device.device_frames(spark, path, 40), f"file://{tmp_path}/out", "scan", f"file://{tmp_path}/log", halt=lambda: device.fix_end(path))
        time.sleep(2)
        publisher.stop()
        end = device.fix_end(path)
        more = len(sent)
        time.sleep(0.1)
        assert len(sent) > more  # the camera still runs
    finally:
        going.set()
        thread.join()
    assert frames_of(publisher) == list(range(end)) and 5 <= end < len(sent)
    device.release(path)  # a new publisher goes on where the last one ended, and each frame is published once
    again = live.Publisher(device.device_frames(spark, path, 1000), f"file://{tmp_path}/out", "scan", f"file://{tmp_path}/log", halt=lambda: device.fix_end(path))
    again.stop()
    assert frames_of(again) == list(range(len(sent)))


def test_a_gap_holds_the_frames_behind_it_back(spark, tmp_path):
    film(tmp_path / "d", [0, 1, 3])
    assert device.fix_end(f"file://{tmp_path}/d") == 2
    film(tmp_path / "d", [2])
    assert device.fix_end(f"file://{tmp_path}/d") == 2
    device.release(f"file://{tmp_path}/d")
    assert device.fix_end(f"file://{tmp_path}/d") == 4


def test_each_path_once_over_a_restart(spark, tmp_path):
    place, calls = tmp_path / "in", (f"file://{tmp_path}/rows", "append", f"file://{tmp_path}/log")
    place.mkdir()
    parse = lambda content: {"sum": sum(map(float, content.split()))}
    (place / "a.txt").write_text("1 2 3")
    (place / "b.txt").write_text("x")
    (place / "c.log").write_text("9")
    run = lambda: {r.path.rsplit("/", 1)[-1]: (r["values"], (r.error or "").split(":")[0]) for r in live.collected(device.watched(spark, f"file://{place}", parse, "*.txt"), *calls).collect()}
    first = run()
    assert first == {"a.txt": ({"sum": 6.0}, ""), "b.txt": (None, "ValueError")}
    (place / "b.txt").write_text("4")  # failed files are not tried again
    (place / "d.txt").write_text("7")
    second = run()
    assert second == first | {"d.txt": ({"sum": 7.0}, "")}
    assert live.collected(device.watched(spark, f"file://{place}", parse, "*.txt"), *calls).count() == 3


def test_the_driver_lists_no_watched_files(spark, tmp_path):
    place = tmp_path / "in"
    for k in range(30):
        (place / f"a={k % 3}" / f"b={k}").mkdir(parents=True)
        (place / f"a={k % 3}" / f"b={k}" / "f.txt").write_text(f"{k}")
    (place / "top.txt").write_text("100")
    (place / "_hidden.txt").write_text("1")
    stream = device.watched(spark, f"file://{place}", lambda content: {"x": float(content)}, "*.txt")
    calls = (f"file://{tmp_path}/rows", "append", f"file://{tmp_path}/log")
    assert sorted(r["values"]["x"] for r in live.collected(stream, *calls).collect()) == [*map(float, range(30)), 100.0]
    kept = [f.read_text() for f in (tmp_path / "log" / "sources").rglob("*") if f.is_file() and not f.name.endswith(".crc")]
    assert not any("f.txt" in text for text in kept)  # the source's log would hold every path


def test_a_backlog_is_published_in_few_batches(spark, tmp_path):
    path = f"file://{tmp_path}/device"
    film(tmp_path / "device", range(900))
    publisher = live.Publisher(device.device_frames(spark, path, 10), f"file://{tmp_path}/out", "scan", f"file://{tmp_path}/log", halt=lambda: device.fix_end(path))
    publisher.stop()
    assert frames_of(publisher) == list(range(900))
    assert len(list((tmp_path / "out").glob("batch=*"))) < 30  # 90 of ten frames
