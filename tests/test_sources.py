import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from quorate.operators import filetype as ft
from quorate.operators import headers as hd
from quorate.operators import vectoriser as vz
from quorate.sources import corpus as src
from quorate.sources import responses as rp
from quorate.sources import signatures as sg
from quorate.sources import sinks as sk


def put(root, rel, data=b"x"):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)


def test_corpus_scan(spark, tmp_path):
    root = str(tmp_path / "c")
    for rel in ("malware/a.exe", "Benign/b.dll", "other/c.bin", "malware/d.txt", "malware/x/y/z/deep.exe", "benign/noext"):
        put(root, rel)
    got = {r["rel_path"]: r["label"] for r in src.read_corpus(spark, root).collect()}
    assert got == {"malware/a.exe": 1, "Benign/b.dll": 0, "other/c.bin": -1, "benign/noext": 0, "malware/x/y/z/deep.exe": 1}
    assert src.read_corpus(spark, root, max_depth=2).count() == 4


def test_year_corpus(spark, tmp_path):
    root = str(tmp_path / "y")
    for rel in ("2019/a.bin", "2020/s/b.bin", "misc/c.bin"):
        put(root, rel)
    assert sorted(r["year"] for r in src.read_year_corpus(spark, root).select("year").collect()) == [2019, 2020]


def test_metadata_precedence(spark, tmp_path):
    root = str(tmp_path / "m")
    put(root, "malware/a.exe")
    assert src.read_metadata(spark, root).count() == 1
    put(root, "metadata.csv", b"sha256,path,label,month,family\nff,s/1,1,3,x\n,s/2,0,4,\n")
    got = {r["path"]: (r["label"], r["period"], r["family"]) for r in src.read_metadata(spark, root).collect()}
    assert got == {f"{root}/s/1": (1, 3, "x"), f"{root}/s/2": (0, 4, "unknown")}
    put(root, "metadata.jsonl", b'{"file": "q", "malware": true, "appeared_month": 5}\n\n')
    assert [tuple(r) for r in src.read_metadata(spark, root).select("path", "label", "period").collect()] == [(f"{root}/q", 1, 5)]


def test_feature_error_gate(spark, tmp_path):
    good = json.dumps({"label": 1, "appeared": "2018-02", "histogram": [1.0] * 256})
    lines = [good] * 900 + ["{broken"] * 100
    path = str(tmp_path / "f.jsonl")
    with open(path, "w") as f:
        f.write("\n".join(lines))
    df = src.read_feature_jsonl(spark, path)
    bad = df.where("is_bad").first()
    assert (bad["label"], bad["appeared"], bad["histogram"]) == (-1, "1970-01", None)
    with open(path, "a") as f:
        f.write("\n" + "\n".join(["{broken"] * 50))
    with pytest.raises(src.ErrorRateExceeded):
        src.read_feature_jsonl(spark, path)


def test_float_matrix(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3)
    path = str(tmp_path / "x.dat")
    m.tofile(path)
    got = src.read_float_matrix(spark, path, 4).orderBy("row_id").collect()
    assert [r["row_id"] for r in got] == [0, 1, 2, 3] and np.allclose([r["vec"] for r in got], m)
    with pytest.raises(ValueError):
        src.read_float_matrix(spark, path, 4, 5)
    with pytest.raises(ValueError):
        src.read_float_matrix(spark, path, 5)


def test_float_matrix_in_ranges_and_files(spark, tmp_path):
    m = np.random.default_rng(1).normal(size=(1000, 7)).astype("<f4")
    path = str(tmp_path / "m")
    df = spark.createDataFrame([(i * 3, [float(x) for x in r]) for i, r in enumerate(m)], "k int, v array<double>").repartition(5)
    src.write_float_matrix(df, path, "v", 7, ["k"])
    got = src.read_float_matrix(spark, path, 1000, range_bytes=7 * 4 * 100)
    assert got.rdd.getNumPartitions() >= 10 and "ExistingRDD" not in got._jdf.queryExecution().toString()
    rows = got.orderBy("row_id").collect()
    assert [r["row_id"] for r in rows] == list(range(1000)) and (np.array([r["vec"] for r in rows], dtype="<f4") == m).all()
    short = spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "k int, v array<double>")
    with pytest.raises(Exception, match="every vector"):
        src.write_float_matrix(short, str(tmp_path / "bad"), "v", 2, ["k"])
    assert not [f for f in (tmp_path / "bad").glob("part-*")]


def test_graph_file(spark, tmp_path):
    rec = {"hash": "h", "label": 1, "function_edges": [[0, 1], [1, 2]], "acfg_list": [{"block_number": 1, "block_edges": [[], []], "block_features": [[1.0, 2.0]]}],
           "function_names": ["f", "CreateFileA", "Sleep"], "function_number": 3}
    path = str(tmp_path / "g.jsonl")
    with open(path, "w") as f:
        f.write(json.dumps(rec))
    g = src.read_graph_jsonl(spark, path)
    assert [tuple(r) for r in src.graph_edges(g).collect()] == [("h", 0, 1), ("h", 1, 2)]
    assert [r["name"] for r in src.graph_names(g).where("external").collect()] == ["CreateFileA", "Sleep"]
    assert src.graph_blocks(g).first()["features"] == [1.0, 2.0]


def test_signature_files(spark, tmp_path):
    path = str(tmp_path / "s.hdb")
    a, b = "a" * 64, "B" * 64
    with open(path, "w") as f:
        f.write(f"# c\n{a}:12:n\n{a}:13:n2\n{b}:*:n\n{'c' * 32}:5:m\nshort\n{'z' * 64}:1:n\n{'d' * 64}:0:n\n")
    got = {r["digest"]: r["size"] for r in sg.read_hash_signatures(spark, path, "sha256").collect()}
    assert got == {a: 12, b.lower(): None, "d" * 64: None}
    path = str(tmp_path / "f.hdb")
    with open(path, "w") as f:
        f.write(f"{a}:7:n:sd:AB:abc:{'1' * 32}:\n{b}:8:m:sd:ab::zz:\nxx:1:n:a:b:c:d:e\n")
    got = {(r["hash_type"], r["value"]): (r["size"], r["name"]) for r in sg.read_fuzzy_signatures(spark, path).collect()}
    assert got == {("ssdeep", "sd"): (7, "n"), ("vhash", "ab"): (7, "n"), ("imphash", "1" * 32): (7, "n")}


def test_responses_file(spark, tmp_path):
    path = str(tmp_path / "r.jsonl")
    with open(path, "w") as f:
        f.write('{"Result": {"x": 1}, "models": {"a": "87%", "b": {"label": "clean", "benign_prob": 0.9}}}\n{"verdict": "Virus"}\n')
    got = {r["name"]: (r["probability"], r["result"]) for r in rp.read_model_responses(spark, path).collect()}
    assert got == {"a": (0.87, "malicious"), "b": (0.1, "benign"), "ensemble": (None, "malicious")}


def test_publish_and_report(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3 + 1, i % 2, "fam", f"{i:064x}") for i in range(30)], "sample_id bigint, period int, label int, family string, sha256 string")
    out = str(tmp_path / "d")
    sk.write_dataset(df, out, files_per_period=2)
    back = spark.read.parquet(out)
    assert back.count() == 30 and sorted(x for x in os.listdir(out) if x.startswith("period=")) == ["period=1", "period=2", "period=3"]
    sk.write_index(df, str(tmp_path / "i"))
    assert json.loads(spark.read.text(str(tmp_path / "i")).first()["value"]).keys() == {"month", "label", "family"}
    sk.write_manifest(df, str(tmp_path / "mf"))
    assert spark.read.json(str(tmp_path / "mf/counts")).where("period is null and label is null").first()["n"] == 30
    rep = spark.createDataFrame([(1, 0.91239, float("nan"), True)], "period int, auc double, gap double, drift boolean")
    sk.write_report(rep, str(tmp_path / "rp"), four=["auc"], two=["gap"], flags=["drift"])
    assert json.loads(spark.read.text(str(tmp_path / "rp/results_json")).first()["value"])["gap"] is None
    assert spark.read.option("header", "true").csv(str(tmp_path / "rp/summary_csv")).first()["auc"] == "0.9124"


def header(machine=0x8664, n=1, opt=240, off=64, sig=b"PE\0\0", magic=b"MZ", raw=0, stamp=1600000000, cut=None):
    h = magic + b"\0" * 58 + struct.pack("<I", off) + sig + struct.pack("<HHIIIHH", machine, n, stamp, 0, 0, opt, 0) + b"\0" * opt
    h += b"".join(struct.pack("<8sIIIIIIHHI", b".text", 1, 2, 16, raw, 0, 0, 0, 0, 0) for _ in range(n))
    return h[:cut] if cut else h


def test_header_reasons(spark):
    cases = {"ok64": header(), "ok32": header(machine=0x14C), "small": header(cut=40), "magic": header(magic=b"ZM"), "offset": header(off=5_000_000), "sig": header(sig=b"NE\0\0"),
             "machine": header(machine=1), "table": header(n=3, cut=340), "section": header(raw=10 ** 6)}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "name string, content binary")
    got = {r["name"]: r["reason"] for r in hd.validate_header(df, "content").collect()}
    assert got == {"ok64": "ok", "ok32": "ok", "small": "file too small", "magic": "bad magic", "offset": "header offset out of range", "sig": "bad signature",
                   "machine": "unknown machine", "table": "section table outside file", "section": "section 0 outside file"}
    p = {r["name"]: (r["year"], r["month"]) for r in hd.header_period(df, "content").collect()}
    assert p["ok64"] == (2020, 9) and p["magic"] == (None, None)
    old = spark.createDataFrame([(bytearray(header(stamp=10)),)], "content binary")
    assert hd.header_period(old, "content").first()["year"] is None


def test_file_types(spark):
    entry = lambda name: b"PK\x03\x04" + b"\x00" * 26 + name
    cases = {"zip": b"PK\x03\x04rest", "docx": entry(b"[Content_Types].xml") + b"x" * 3000 + entry(b"word/document.xml"), "jar": entry(b"META-INF/MANIFEST.MF"), "odf": entry(b"mimetypeapplication/vnd.oasis"), "pdf": b"%PDF-1.4", "elf": b"\x7fELF\x01", "tar": b"a" * 257 + b"ustar" + b"b" * 20, "html": b"  <html><body>", "bom": b"\xef\xbb\xbfhi there",
             "utf16": b"\xff\xfeh\0i\0", "zeros": b"h\0e\0l\0l\0o\0", "empty": b"", "pe": b"MZ" + b"\x01" * 120 + b"PE\0\0", "text": b"plain words here\n", "utf8": "é".encode() * 30,
             "binary": b"\xfe\x01\x02\x80\x81\x99\xa0\xff\xf1", "dmg": b"\x80\x81" * 300 + b"koly", "class": b"\xca\xfe\xba\xbe\x00\x00\x00\x03"}
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "name string, content binary")
    got = {r["name"]: r["type_code"] for r in ft.tag_file_type(df, "content").collect()}
    assert got == {"zip": "ZIP", "docx": "OOXML_WORD", "jar": "JAVA", "odf": "ODF", "pdf": "PDF", "elf": "ELF", "tar": "POSIX_TAR", "html": "HTML", "bom": "TEXT_UTF8", "utf16": "TEXT_UTF16LE", "zeros": "TEXT_UTF16LE", "empty": "ANY",
                   "pe": "MSEXE", "text": "TEXT_ASCII", "utf8": "TEXT_UTF8", "binary": "BINARY_DATA", "dmg": "DMG", "class": "MACHO_UNIBIN"}


def test_vector_layout(spark):
    import hashlib
    rec = {"label": 1, "appeared": "2020-01", "histogram": list(range(256)), "byteentropy": [0.5] * 10, "strings": {"numstrings": 4, "MZ": 2, "printabledist": [1, 2]},
           "general": {"size": 9, "symbols": 7}, "header": {"coff": {"machine": "AMD64", "timestamp": 5, "characteristics": ["A", "B"]}, "optional": {"magic": "PE32"}},
           "section": {"entry": ".text", "sections": [{"name": ".text", "size": 10, "entropy": 6.5, "vsize": 11, "props": ["X"]}]},
           "imports": {"KERNEL32.dll": ["Sleep", "sleep"]}, "exports": ["Run"], "datadirectories": [{"size": 3, "virtual_address": 4}]}
    lines = spark.createDataFrame([(json.dumps(rec),)], "value string")
    v = vz.vectorise(src.parse_features(lines)).first()["vec"]
    num = lambda s: int(hashlib.md5(s.encode()).hexdigest()[:8], 16)
    sign = lambda s: 1.0 if num(s) >> 31 else -1.0
    assert len(v) == vz.DIM and v[:256] == [float(i) for i in range(256)] and v[256:512] == [0.0] * 256
    assert v[512] == 4 and v[519] == 2 and v[520:523] == [1, 2, 0] and v[616] == 9 and v[625] == 7
    assert v[626] == 5 and v[627] == num("AMD64") % 65536 and v[628] == num("A,B") % 65536 and v[631] == num("PE32") % 65536
    assert v[688] == 1 and v[689] == num(".text") % 65536 and v[693:697] == [10, 6.5, 11, num(".text") % 65536] and v[697] == num("X") % 65536
    assert v[943 + num("kernel32.dll") % 256] == sign("kernel32.dll") and v[943 + 256 + num("sleep") % 1024] == 2 * sign("sleep")
    assert v[2223 + num("run") % 128] == sign("run") and v[2351:2353] == [3, 4]


def test_lines_keep_file_order(spark, tmp_path):
    for name, rows in (("a.txt", ["one", "two"]), ("b.txt", ["three"])):
        with open(tmp_path / name, "w") as f:
            f.write("\n".join(rows) + "\n")
    got = sg.read_lines(spark, str(tmp_path)).repartition(3).orderBy("row_id")
    assert [r["value"] for r in got.collect()] == ["one", "two", "three"]


def test_published_periods_are_split_by_size(spark, tmp_path):
    out = str(tmp_path / "p")
    rows = spark.range(20_000).select(F.col("id").alias("sample_id"), F.when(F.col("id") < 18_000, 1).otherwise(2).alias("period"))
    sk.write_dataset(rows, out)
    back = spark.read.parquet(out)
    assert back.count() == 20_000
    assert len([f for f in os.listdir(f"{out}/period=1") if f.endswith(".parquet")]) >= 1


def test_intermediate_tables_can_be_dropped(spark):
    from quorate import session
    session.reliable_table(spark.range(3))
    assert session.drop_intermediate(spark) >= 1 and session.drop_intermediate(spark) == 0


def test_a_cluster_without_shared_folder_is_an_error():
    from types import SimpleNamespace

    from quorate import session
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda key, default=None: {"spark.master": "spark://host:7077"}.get(key, default)))
    with pytest.raises(ValueError):
        session.shared_dir(fake)


def test_header_stamp_too_large_for_its_field_is_no_period(spark):
    # the first 32 bits or the last 8 digits of these stamps would be a valid time
    stamps = [1600000000, 1600000000 * 16 + 5, (1 << 32) + 1600000000]
    df = spark.createDataFrame([(s,) for s in stamps], "stamp bigint").select("stamp", hd.little_endian(F.col("stamp"), 4).alias("h"))
    head = header()
    at = head.index(struct.pack("<I", 1_600_000_000))
    spelled = {r["stamp"]: bytes.fromhex(r["h"]) for r in df.collect()}
    files = spark.createDataFrame([(s, bytearray(head[:at] + spelled[s] + head[at + 4:])) for s in stamps], "stamp bigint, content binary")
    got = {r["stamp"]: r["year"] for r in hd.header_period(files, "content").collect()}
    assert got == {stamps[0]: 2020, stamps[1]: None, stamps[2]: None}


def test_names_are_hashed_once_per_batch(monkeypatch):
    import hashlib

    import pyarrow as pa
    seen, heads = [], vz._heads
    monkeypatch.setattr(vz, "_heads", lambda names: seen.extend(names.to_pylist()) or heads(names))
    rows = [["a", "B", "a", "", None], None, [], ["b", "a"]] * 700
    got = vz._hashed_bag.func(pa.array(rows, pa.list_(pa.string())), pa.array([1024] * len(rows))).to_pylist()
    assert sorted(seen) == ["B", "a", "b"]
    for row, cells in zip(rows, got):
        want = np.zeros(1024)
        for x in filter(None, row or []):
            h = int(hashlib.md5(x.lower().encode()).hexdigest()[:8], 16)
            want[h % 1024] += 1 if h >> 31 & 1 else -1
        assert cells == want.tolist()


def test_responses_are_parsed_once_for_all_keys(spark):
    rows = [(1, '{"models": {"a": {"score": "70%", "verdict": "Bad"}, "b": 0.2}}'), (2, '{"benign_prob": 0.9, "label": "clean"}'), (3, '{"Scores": [{"name": "n", "isMalware": true}, null, 55]}'),
            (4, "not json"), (5, None), (6, '{"probability": null, "prob": 1.5, "Status": "SAFE "}')]
    df = spark.createDataFrame(rows, "row_id int, value string")
    out = rp.normalise(df, "value", ["row_id"])
    assert "get_json_object(item" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["row_id"], r["name"]): (r["probability"], r["result"]) for r in out.collect()}
    assert got[1, "a"] == (0.7, "malicious") and got[1, "b"] == (0.2, "benign") and got[2, "ensemble"] == (0.1, "benign")
    assert got[3, "n"] == (None, "malicious") and got[3, "Model-3"] == (0.55, "malicious") and got[6, "ensemble"] == (0.015, "benign")
