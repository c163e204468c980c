"""Zip archives of station files: a task a member, skipped members are not inflated, damaged ones raise."""

import io
import random
import zipfile

import pytest

from gaugemark.sources import observations, zips

TITLES = "Data;Hora UTC;PRECIPITAÇÃO TOTAL, HORÁRIO (mm);TEMPERATURA DO AR - BULBO SECO, HORARIA (°C);VENTO, VELOCIDADE HORARIA (m/s);"


def station(code, hours, seed=0):
    r = random.Random(seed)
    head = [f"REGIAO:;S\nUF:;RS\nESTACAO:;{code} TOWN\nCÓDIGO (WMO):;{code}\nLATITUDE:;-30,05\nLONGITUDE:;-51,1\nALTITUDE:;41,18\nDATA DE FUNDACAO:;2000-09-22", TITLES]
    return "\n".join(head + [f"2025/01/{1 + h // 24:02d};{h % 24:02d}00 UTC;{r.randint(0, 9)},{r.randint(0, 9)};{r.randint(10, 35)},5;,{r.randint(1, 9)};" for h in range(hours)]) + "\n"


def archive(path, files, method=zipfile.ZIP_DEFLATED):
    with zipfile.ZipFile(path, "w", method) as z:
        for name, text in files.items():
            z.writestr(name, text.encode("latin-1"))


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED])
def test_members_are_read_by_tasks_of_their_own(spark, tmp_path, method):
    first = {"2025/A801.CSV": station("A801", 30), "2025/A802.csv": station("A802", 50, 1), "2025/readme.txt": "no data"}
    archive(tmp_path / "2025.zip", first, method)
    archive(tmp_path / "2026.zip", {"A801.CSV": station("A801", 5, 2)}, method)
    files = observations.read_zip_texts(spark, str(tmp_path))
    assert files.rdd.getNumPartitions() == 3
    got = {r["path"]: r["text"] for r in files.collect()}
    assert got == {f"{tmp_path}/2025.zip/2025/A801.CSV": first["2025/A801.CSV"], f"{tmp_path}/2025.zip/2025/A802.csv": first["2025/A802.csv"], f"{tmp_path}/2026.zip/A801.CSV": station("A801", 5, 2)}
    parsed = observations.parse_station_files(files)
    assert observations.emitted(parsed, "1").count() == 3 * 85
    assert observations.check(parsed, "zips")["rows_out"] == 255
    archive(tmp_path / "2027.zip", {"readme.txt": "none"})
    assert observations.read_zip_texts(spark, f"{tmp_path}/2027.zip").collect() == []


def test_other_stations_are_counted_but_not_inflated(spark, tmp_path):
    archive(tmp_path / "a.zip", {f"A80{k}.CSV": station(f"A80{k}", 700, k) for k in range(4)})
    files = observations.read_zip_texts(spark, f"{tmp_path}/a.zip", stations=["A802"])
    sizes = {r["path"][-8:]: len(r["text"]) for r in files.collect()}
    assert sizes["A802.CSV"] == len(station("A802", 700, 2)) and all(n < 500 for k, n in sizes.items() if k != "A802.CSV")
    assert observations.file_counts(files, ["A802"]).first().asDict() == {"read": 1, "skipped": 3}
    assert observations.emitted(observations.parse_station_files(files, ["A802"]), "1").count() == 2100
    assert observations.read_zip_texts(spark, f"{tmp_path}/a.zip", stations=[]).count() == 4


def test_inflating_stops_at_the_head(tmp_path, monkeypatch):
    r = random.Random(1)
    long = station("A801", 2) + "".join(f"{r.random()}\n" for _ in range(200_000))
    archive(tmp_path / "a.zip", {"A801.CSV": long})
    (piece,) = zips.members(str(tmp_path / "a.zip"))
    read = []
    monkeypatch.setattr(zips, "read_at", lambda f, at, n, real=zips.read_at: read.append(n) or real(f, at, n))
    with zips.opened(piece.path) as f:
        pieces = list(map(len, zips.inflated(piece, f)))
        assert sum(pieces) == len(long) and max(pieces) <= zips.CHUNK_BYTES and max(read) <= zips.CHUNK_BYTES
        read.clear()
        head = zips.text_of(piece, f, "latin-1", frozenset(["B1"]))
        assert sum(read) <= zips.CHUNK_BYTES + 30 and head == "\n".join(long.split("\n")[:9])
        assert zips.text_of(piece, f, "latin-1", frozenset(["A801"])) == long
    assert zips.station_of(head) == "A801" and zips.station_of("UF:;RS\n") is None


def test_short_members_and_damaged_archives(spark, tmp_path):
    archive(tmp_path / "short.zip", {"a.csv": "UF:;RS\nCODIGO (WMO):;A1", "b.csv": ""})
    assert sorted(r["text"] for r in observations.read_zip_texts(spark, f"{tmp_path}/short.zip", stations=["A9"]).collect()) == ["", "UF:;RS\nCODIGO (WMO):;A1"]
    archive(tmp_path / "good.zip", {"a.csv": station("A1", 300)}, zipfile.ZIP_STORED)
    data = bytearray((tmp_path / "good.zip").read_bytes())
    data[2000] ^= 1
    (tmp_path / "bad.zip").write_bytes(data)
    (tmp_path / "cut.zip").write_bytes(data[:500])
    buffer = io.BytesIO()
    archive(buffer, {"a.csv": "x"}, zipfile.ZIP_BZIP2)
    (tmp_path / "odd.zip").write_bytes(buffer.getvalue())
    for name, text in (("bad", "checksum"), ("cut", "zip file"), ("odd", "method 12")):
        with pytest.raises(Exception, match=text):
            observations.read_zip_texts(spark, f"{tmp_path}/{name}.zip").collect()
