"""Records as archives have them, written by hand."""

import gzip
import json
import zlib

import pytest

from nearkin.llm import warc


def raw(version, headers, block):
    return f"{version}\r\n".encode() + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers) + f"Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


PAGE = "<html><body><p>Füße &amp; more</p></body></html>"
LATIN = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=ISO-8859-1\r\nX-Long: a\r\n b\r\n\r\n" + PAGE.encode("latin-1")
body = gzip.compress(PAGE.encode())
CHUNKED = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\nContent-Encoding: gzip\r\n\r\n" + b"".join(b"%x\r\n%s\r\n" % (len(body[k : k + 7]), body[k : k + 7]) for k in range(0, len(body), 7)) + b"0\r\n\r\n"
META = b"HTTP/1.0 200 OK\n\n<meta charset='windows-1252'><p>F\xfc\xdfe & more \x93"
ID = [("WARC-Record-ID", "<urn:uuid:1>"), ("WARC-Date", "2011-02-03T04:05:06Z"), ("WARC-Target-URI", "<http://x.example/>")]
OLD = raw("WARC/1.0", [("warc-type", "response"), *ID], LATIN)


def derived(source):
    return {h["warc-type"]: (h, block) for h, block in map(warc.parse, warc.derive(source))}


@pytest.mark.parametrize("block, text", [(LATIN, "Füße & more"), (CHUNKED, "Füße & more"), (META, "Füße & more “"), (b"", ""), (b"HTTP/1.1 204 No Content\r\n\r\n", ""), (b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n<p>never chunked", "never chunked")])
def test_bodies(block, text):
    made = derived(raw("WARC/1.0", [("warc-type", "response"), *ID], block))
    assert made["conversion"][1].decode() == text
    for h, _ in made.values():
        assert (h["warc-refers-to"], h["warc-refers-to-date"], h["warc-refers-to-target-uri"]) == ("<urn:uuid:1>", "2011-02-03T04:05:06Z", "http://x.example/")


def test_headers():
    about = json.loads(derived(OLD)["metadata"][1])
    assert ["X-Long", "a b"] in about["http-headers"] and about["http-status"] == "HTTP/1.1 200 OK"
    assert about["source-payload-digest"] == warc.digest(PAGE.encode("latin-1")) and about["source-block-digest"] == warc.digest(LATIN)
    bare = raw("WARC/1.1", [("WARC-Type", "response")], LATIN)
    again = [derived(bare)["conversion"][0]["warc-refers-to"] for _ in range(2)]
    assert again[0] == again[1] and again[0].startswith("<urn:uuid:")
    assert derived(raw("WARC/1.0", [("WARC-Type", "resource"), ("Content-Type", "text/html")], PAGE.encode()))["conversion"][1].decode() == "Füße & more"
    for kind in ("request", "warcinfo", "revisit", ""):
        assert warc.derive(raw("WARC/1.0", [("WARC-Type", kind)], b"x")) == []
    ok = raw("WARC/1.0", [("WARC-Type", "response"), ("WARC-Block-Digest", "sha1:" + warc.digest(LATIN)[5:].lower())], LATIN)
    assert len(warc.derive(ok)) == 2
    for bad in (ok.replace(b"more", b"mire"), OLD[:-20], b"", b"junk", b"WARC/1.0\r\nWARC-Type: response\r\n\r\n", OLD + b"x"):
        with pytest.raises(ValueError):
            warc.derive(bad)


def test_files(spark, tmp_path):
    other = raw("WARC/1.0", [("WARC-Type", "request"), *ID], b"GET / HTTP/1.1\r\n\r\n")
    new = raw("WARC/1.1", [("WARC-Type", "response"), *ID], META * 100_000)  # longer than what is read at a time
    damaged = bytearray(gzip.compress(OLD * 50))
    damaged[30] ^= 255
    files = {
        "a.warc.gz": gzip.compress(other) + gzip.compress(OLD) + gzip.compress(new, 0) + gzip.compress(OLD),
        "b.warc": other + OLD + new + OLD,
        "c.warc.gz": gzip.compress(OLD) + bytes(damaged) + gzip.compress(OLD),
        "d.warc.gz": gzip.compress(OLD + other + OLD),
        "e.warc": OLD + b"junk\r\n" + OLD + other[:-30],
        "f.warc.gz": gzip.compress(OLD)[:-40],
        "g.warc": b"",
    }
    for name, data in files.items():
        (tmp_path / name).write_bytes(data)
    names = spark.createDataFrame([(str(tmp_path / n), "clash") for n in files] + [(None, "")], "path string, record string")
    rows = warc.read_warc(names).collect()
    by = {n: sorted((r["offset"], bytes(r["record"]), r["error"] is not None) for r in rows if r["path"].endswith(n)) for n in files}
    assert [x[1] for x in by["a.warc.gz"]] == [other, OLD, new, OLD] == [x[1] for x in by["b.warc"]]
    for offset, data, _ in by["a.warc.gz"]:
        assert zlib.decompressobj(31).decompress(files["a.warc.gz"][offset:]) == data
    assert all(files["b.warc"][offset:].startswith(data) for offset, data, _ in by["b.warc"])
    assert [x[1] for x in by["c.warc.gz"] if not x[2]] == [OLD, OLD] and sum(x[2] for x in by["c.warc.gz"]) >= 1
    assert sorted(x[1] for x in by["d.warc.gz"]) == sorted([OLD, other, OLD]) and by["f.warc.gz"][0][2] and by["g.warc"] == []
    found = warc.build_derivatives(warc.read_warc(names), str(tmp_path / "out")).collect()
    errors = [r["error"] for r in found if r["error"]]
    assert sum(r["error"] is None for r in found) == 2 * (3 + 3 + 2 + 2 + 2) and len(errors) >= 4  # responses in a to e
    nulls = warc.build_derivatives(spark.createDataFrame([(None,)], "record binary")).collect()
    assert [(r["record_id"], r["error"]) for r in nulls] == [(None, "no record")]
