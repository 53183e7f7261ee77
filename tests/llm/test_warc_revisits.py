"""Archives that hold revisits and other records already."""

import base64
import hashlib
import uuid

from pyspark.sql import functions as F

from graniq.llm import warc
from graniq.llm.storage import open_fs, shared_dir

BIG = b"<p>" + b"x" * 1500 + b"</p>"


def archive(spark, members):
    """A manifest of one archive with these members."""
    path = shared_dir(spark, "warc-foreign") + ".warc.gz"
    fs, where = open_fs(path)
    fs.create_dir(where.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(where) as out:
        out.write(b"".join([warc.info("x"), *members]))
    return spark.createDataFrame([(path, len(members), 0)], warc.MANIFEST)


def contents(manifest):
    """Type, id, digest, original, block of all records but warcinfo, without dates of writing."""
    told = []
    for r in manifest.collect():
        for _, raw in warc.members(r["path"]):
            fields, block = warc.parse(raw)
            if fields["WARC-Type"] != "warcinfo":
                told.append((fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Payload-Digest"), fields.get("WARC-Refers-To"), fields.get("WARC-Refers-To-Date"), fields.get("WARC-Refers-To-Target-URI"), fields.get("WARC-Profile"), fields["WARC-Date"], block))
    return sorted(told, key=str)


def test_resolving_twice_is_resolving_once(spark):
    rows = [(i, f"http://h/{i}", "a" * 1200 if i % 3 else ("b" * 2000 if i % 2 else "short")) for i in range(30)]
    first = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3))
    once = warc.deduplicate(first, warc.headers(first))
    twice = warc.deduplicate(once, warc.headers(once))
    assert contents(once) == contents(twice) and any(r[0] == "revisit" for r in contents(once))
    assert sorted(map(str, warc.resolved(warc.headers(once)).drop("path", "offset").collect())) == sorted(map(str, warc.resolved(warc.headers(twice)).drop("path", "offset").collect()))


def test_archives_from_elsewhere(spark):
    """Ids are no numbers, fields have other cases, digests are hex, revisits come before their response or without one, other types are copied."""
    name = lambda: f"<urn:uuid:{uuid.uuid4()}>"
    head = b"HTTP/1.0 203 Fine\r\nX-Own: yes\r\n\r\n"
    known, lost = hashlib.sha1(BIG).hexdigest(), hashlib.sha1(b"elsewhere").digest()
    ids = [name() for _ in range(7)]
    revisit = lambda i, digest, more=(): warc._member([f"warc-type: revisit", f"WARC-Record-ID:{ids[i]}", "WARC-Date: 2020-01-01T00:00:00Z", f"WARC-Target-URI: http://r/{i}", f"WARC-Payload-Digest: sha1:{digest}", *more], head)
    response = lambda i, payload: warc._member(["WARC-Type: response", f"WARC-Record-ID: {ids[i]}", "WARC-Date: 2019-01-01T00:00:00Z", f"WARC-Target-URI: http://r/{i}", "Content-Type:", "  application/http"], head + payload)
    request = warc._member(["WARC-Type: request", f"WARC-Record-ID: {ids[4]}", "WARC-Date: 2019-01-01T00:00:00Z", f"WARC-Concurrent-To: {ids[2]}"], b"GET / HTTP/1.0\r\n\r\n")
    said = ["WARC-Refers-To: <urn:uuid:gone>", "WARC-Refers-To-Date: 2001-01-01T00:00:00Z", "WARC-Profile: http://other/profile"]
    own = archive(spark, [revisit(0, known), revisit(1, base64.b32encode(lost).decode(), said), response(2, BIG), response(3, b"tiny"), request, revisit(5, hashlib.sha1(b"tiny").hexdigest()), response(6, BIG)])
    done = warc.deduplicate(own, warc.headers(own))
    by = {r[1]: r for r in contents(done)}
    assert len(by) == 7
    kept = [i for i in (2, 6) if by[ids[i]][0] == "response"]
    assert len(kept) == 1 and by[ids[kept[0]]][-1] == head + BIG
    stays = ids[kept[0]]
    other = ids[8 - kept[0]]
    assert by[other][0] == "revisit" and by[other][3] == stays and by[other][-1] == head
    assert by[ids[0]][:4] == ("revisit", ids[0], f"sha1:{known}", stays) and by[ids[0]][5] == f"http://r/{kept[0]}"
    assert by[ids[1]][3:7] == ("<urn:uuid:gone>", "2001-01-01T00:00:00Z", None, "http://other/profile")
    assert by[ids[5]][3] == ids[3] and by[ids[3]][0] == "response"
    assert by[ids[4]][0] == "request" and by[ids[4]][-1] == b"GET / HTTP/1.0\r\n\r\n"
    again = warc.deduplicate(done, warc.headers(done))
    assert contents(again) == contents(done)
    heads = warc.headers(done)
    assert heads.filter("page_id IS NULL").count() == 6 and heads.filter(F.col("record_type") == "revisit").count() == 4
