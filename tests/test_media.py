"""Images as files beside the dataset: named by content, told in a manifest, swept at commit."""

import base64
import hashlib
import json
import os

import pytest

from weftline.operators.generate import CallRules
from weftline.plans.config import Builder, ProcessorConfig, Skip
from weftline.plans.engine import Engine, RunConfig, RunError
from weftline.plans.planner import Resources
from weftline.sources.media import MediaError, MediaStore, folder_of, image_of, manifest, swept

PNG = b"\x89PNG\r\n\x1a\n"


def text(data):
    return base64.b64encode(data).decode()


def engine(spark, **rules):
    def draws(kind, messages, parameters, head=PNG, encode=base64.b64encode):
        said = messages[-1]["content"]
        return {"data": ["no image" if said.endswith("7") else encode(head + said.encode()).decode()]}

    return Engine(spark, Resources(models={"m": draws}), RunConfig(buffer_size=5, calls=CallRules(stop_early=False), **rules))


def pictures(**more):
    b = Builder(3).add_model("m", "any")
    b.add_column(name="n", kind="sampler", sampler_type="category", params={"values": list(range(8))})
    b.add_column(name="pic", kind="image", model_alias="m", prompt="draw {{ n }}", **more)
    return b


def files_of(path):
    return sorted(f for _, _, fs in os.walk(f"{path}/images") for f in fs if not f.endswith(".crc"))


def test_formats_of_images():
    assert image_of(text(PNG)) == (PNG, "png")
    assert image_of("data:image/jpeg;base64," + text(b"\xff\xd8\xff\xe0"))[1] == "jpeg"
    assert image_of("R0lG\nODlh")[1] == "gif"
    assert image_of(text(b"RIFF\0\0\0\0WEBPVP8 "))[1] == "webp"
    for bad in ("", "§", "abc", text(b"BM..."), text(b"RIFF\0\0\0\0WAVE"), None):
        with pytest.raises(MediaError):
            image_of(bad)


def test_a_store_keeps_one_file_for_equal_images(tmp_path):
    store = MediaStore(str(tmp_path))
    a, b = store.save(text(PNG + b"a"), "../x.y"), store.save("data:image/png;base64," + text(PNG + b"a"), "../x.y")
    assert a == b and a.startswith("images/%2E%2E%2Fx%2Ey/") and hashlib.sha256(PNG + b"a").hexdigest() in a
    assert len(files_of(tmp_path)) == 1 and store.load(a) == (text(PNG + b"a"), "png")
    with open(tmp_path / a, "wb") as f:  # half a file of that name is written anew
        f.write(b"half")
    assert store.save(text(PNG + b"a"), "../x.y") == a and store.load(a)[0] == text(PNG + b"a")
    for bad in ("images/x/../../secret.png", "/etc/passwd", a.replace(a[-10:-4], "000000")):
        with pytest.raises(MediaError):
            store.load(bad)


def test_sweep_deletes_what_no_row_names(spark, tmp_path):
    store = MediaStore(str(tmp_path))
    kept, lost, gone = (store.save(text(PNG + x), "pic") for x in (b"1", b"2", b"3"))
    os.remove(tmp_path / gone)
    (tmp_path / "images/pic" / kept.split("/")[2] / ".half-written").write_bytes(b"x")
    rows = spark.createDataFrame([(0, [kept, None, kept]), (1, [kept, gone]), (1, None), (2, ["instead"])], "b long, pic array<string>")
    named = manifest(rows, ["pic"], "b")
    assert sorted(map(tuple, named.collect())) == sorted([(0, "pic", kept, 2), (1, "pic", kept, 1), (1, "pic", gone, 1)])
    told = swept(spark, str(tmp_path), ["pic"], named)
    assert told == {"files": 1, "bytes": len(PNG) + 1, "swept": 2, "missing": 1}
    assert files_of(tmp_path) == [os.path.basename(kept)]
    assert swept(spark, str(tmp_path), ["pic", "other"], named.where("false")) == {"files": 0, "bytes": 0, "swept": 1, "missing": 0}


def test_run_writes_files_and_drops_rows_without_an_image(spark, tmp_path):
    got = engine(spark).create(pictures(), 40, str(tmp_path / "d"))
    rows = got.load_dataset().collect()
    assert 0 < len(rows) < 40 and all(r["n"] != 7 for r in rows)
    assert got.metadata["dropped"] == {"pic:model": 40 - len(rows)}
    for r in rows:
        want = PNG + f"draw {r['n']}".encode()
        assert r["pic"] == [f"{folder_of('pic')}/{hashlib.sha256(want).hexdigest()[:3]}/{hashlib.sha256(want).hexdigest()}.png"]
        assert open(tmp_path / "d" / r["pic"][0], "rb").read() == want
    assert got.metadata["images"]["files"] == len({r["n"] for r in rows}) == len(files_of(tmp_path / "d"))
    assert {(r["path"], bytes(r["content"])) for r in got.load_images().collect()} == {(r["pic"][0], PNG + f"draw {r['n']}".encode()) for r in rows}


def test_preview_keeps_images_in_cells(spark):
    rows = engine(spark).preview(pictures(), 6).collect()
    assert all(base64.b64decode(r["pic"][0]).endswith(str(r["n"]).encode()) for r in rows if r["n"] != 7)


def test_resumed_run_sweeps_and_extends(spark, tmp_path):
    path = str(tmp_path / "d")
    engine(spark).create(pictures(), 10, path)
    orphan = MediaStore(path).save(text(PNG + b"of a lost task"), "pic")
    got = engine(spark, resume="always").create(pictures(), 30, path)
    assert got.metadata["images"]["swept"] == 1 and got.metadata["images"]["missing"] == 0 and not os.path.exists(f"{path}/{orphan}")
    whole = engine(spark).create(pictures(), 30, str(tmp_path / "whole"))
    assert sorted(map(str, got.load_dataset().collect())) == sorted(map(str, whole.load_dataset().collect()))
    assert files_of(path) == files_of(tmp_path / "whole")
    os.remove(f"{path}/{got.load_dataset().first()['pic'][0]}")
    with pytest.raises(RunError, match="1 images"):
        engine(spark, resume="always").create(pictures(), 30, path)
    assert not json.load(open(f"{path}/metadata.json"))["complete"]


def test_dropped_image_columns_and_skipped_cells(spark, tmp_path):
    b = pictures(skip=Skip("n < 4", ["none"])).add_processor(ProcessorConfig("cut", "drop_columns", column_names=["pic"]))
    got = engine(spark).create(b, 30, str(tmp_path / "d"))
    cells = {r["pic"][0] for r in got.load_dropped().collect()}
    assert "none" in cells and got.metadata["images"] | {"bytes": 0, "swept": 0} == {"files": len(cells) - 1, "bytes": 0, "swept": 0, "missing": 0}
