"""Archives on disk: ZIP and JS, good and broken, whole and cut."""

import datetime as dt
import io
import json
import random
import zipfile

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from postaudit import catalog, schema as S
from postaudit.fixtures import _zip_batches
from postaudit.functions.posts import parse_created_at
from postaudit.functions.text import array_to_json, from_rfc3339, json_to_array, rfc3339
from postaudit.sources import archives as A
from postaudit.sources.chunks import BLOCK_BYTES, element_chunks, post_members, read_archive, read_path

RUN = dt.datetime(2025, 1, 1, tzinfo=dt.timezone.utc)
HEAD = "window.YTD.tweets.part0 = "


def job_name():
    return F.regexp_extract("path", r"([^/]*)\.[^.]*$", 1)


def post(name, text, **entities):
    return {"tweet": {"id_str": name, "full_text": text, "created_at": "Mon Jan 02 15:04:05 +0000 2023",
                      "entities": entities}}


FULL = post("71", "harbour at dawn",
            urls=[{"expanded_url": "https://maps.test/h", "url": "https://s.test/1"}],
            hashtags=[{"text": "boats"}], user_mentions=[{"screen_name": "pilot"}],
            media=[{"media_url": "https://pics.test/7.png"}])
REPOST = post("72", "RT @pilot: fog again")


def js(*posts):
    return HEAD + json.dumps(list(posts), indent=1) + ";"


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, body in members.items():
            z.writestr(name.replace("__", "/").replace("_js", ".js"), body)
    return out.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("archives")
    files = {
        "zip1.zip": zipped(data__other_js="[]", data__tweet_js=js(FULL, REPOST)),
        "plain.js": js(post("73", "no archive around it")),
        "three.js": js(post("1", "own words"), post("2", "RT @b: p"), post("3", "RT @c: q")),
        "text.js": b"words, no array",
        "nomember.zip": zipped(data__other_js="no posts"),
        "badjson.js": HEAD + "[neither, nor];",
        "junk.js": js(FULL)[:-1] + " extra]",
        "broken.zip": b"PK\x03\x04 and no more",
        "empty.js": HEAD + "[];",
        "odd.js": HEAD + json.dumps([None, {"tweet": 5}, post("7", "kept"), post("", "no id")]) + ";",
        "utf.js": js(post("8", "good")).encode().replace(b"good", b"b\xffd"),
    }
    for name, body in files.items():
        (path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    return str(path)


@pytest.fixture(scope="module")
def read(spark, folder):
    return A.ingest(A.scan_archives(spark, folder), RUN, job_name())


def test_posts_of_good_archives(read):
    got = {(r.job_id, r.tweet_id): r for r in read.posts.collect()}
    assert set(got) == {("zip1", "71"), ("zip1", "72"), ("plain", "73"), ("three", "1"),
                        ("three", "2"), ("three", "3"), ("odd", "7"), ("utf", "8")}
    row = got["zip1", "71"]
    assert (row.text, row.links, row.hashtags, row.mentions, row.attachments) == (
        "harbour at dawn", ["https://maps.test/h"], ["#boats"], ["@pilot"], ["https://pics.test/7.png"])
    assert row.created_at == dt.datetime(2023, 1, 2, 15, 4, 5) and row.created_at_ok and row.pos == 0
    bare = got["plain", "73"]
    assert (bare.links, bare.hashtags, bare.mentions, bare.attachments) == ([], [], [], [])
    assert got["utf", "8"].text == "b�d"


def test_broken_archives_fail_as_a_whole(read):
    got = {r.job_id: r.error for r in read.bad_archives.collect()}
    assert set(got) == {"text", "nomember", "badjson", "junk", "broken"}
    assert got["text"] == S.ERROR_PREFIX + S.ERROR_UNWRAP
    assert got["nomember"] == S.ERROR_PREFIX + S.ERROR_NO_MEMBER
    assert got["badjson"] == got["junk"] == S.ERROR_PREFIX + S.ERROR_JSON
    assert got["broken"].startswith(S.ERROR_PREFIX + S.ERROR_ZIP)
    assert [(r.job_id, r.pos) for r in read.bad_rows.orderBy("pos").collect()] == [("odd", 0), ("odd", 1), ("odd", 3)]


def test_oversized_archive_is_refused(spark, folder):
    read = A.ingest(A.scan_archives(spark, folder), RUN, job_name(), max_bytes=30)
    refused = {r.job_id for r in read.bad_archives.collect() if "exceeds maximum" in r.error}
    assert "three" in refused and "text" not in refused


def test_cut_archives_equal_whole_ones(spark, folder, read):
    cut = A.ingest(A.scan_archives(spark, folder), RUN, job_name(), chunk_chars=40)
    assert sorted(cut.posts.collect()) == sorted(read.posts.collect())
    whole, pieces = ({r.job_id: r.error for r in i.bad_archives.collect()} for i in (read, cut))
    assert whole == pieces
    assert sorted(cut.bad_rows.collect()) == sorted(read.bad_rows.collect())


def cut_all(text, width, chunk):
    blocks = [(text[i:i + width], False) for i in range(0, len(text), width)] + [("", True)]
    return list(element_chunks(blocks, chunk))


def test_cutting_equals_parsing():
    rnd = random.Random(7)
    alphabet = ['"', "\\", "[", "]", "{", "}", ",", "a", "\n", "=", "é"]
    def value(depth):
        kind = rnd.randrange(4 if depth else 2)
        if kind == 0:
            return "".join(rnd.choices(alphabet, k=rnd.randrange(8)))
        if kind == 1:
            return rnd.randrange(100)
        if kind == 2:
            return [value(depth - 1) for _ in range(rnd.randrange(4))]
        return {str(i): value(depth - 1) for i in range(rnd.randrange(4))}
    for _ in range(300):
        data = [value(3) for _ in range(rnd.randrange(6))]
        text = rnd.choice([HEAD, "", " \n"]) + json.dumps(data, ensure_ascii=False) + rnd.choice([";", "", "\n"])
        pieces = cut_all(text, rnd.randrange(1, 30), rnd.randrange(0, 25))
        joined = []
        for first, piece in pieces:
            assert first == len(joined)
            joined += json.loads(piece)
        assert joined == data


@pytest.mark.parametrize("text", ["[1, 2", "[1,]", "[1] ]", '["a', "nothing", "[{]", "[1}", '[1] x = "]"', "[,1]"])
def test_cutting_reports_or_keeps_what_does_not_parse(text):
    def bad(piece):
        if piece is None:
            return True
        try:
            json.loads(piece)
        except ValueError:
            return True
        return False
    assert any(bad(p) for _, p in cut_all(text, 3, 0))


def test_member_choice():
    names = ["a/Other.js", "data/Deleted-TWEETS.js", "data/tweet.json", "data/tweets.js"]
    assert post_members(names) == ["data/Deleted-TWEETS.js"]
    assert post_members(names, all_parts=True) == ["data/Deleted-TWEETS.js", "data/tweets.js"]
    both = zipped(**{"tweets_js": js(FULL), "tweets-part1_js": js(REPOST)})
    assert [p["member"] for p in read_archive(both, all_parts=True)] == ["tweets.js", "tweets-part1.js"]


@pytest.mark.parametrize("text, expected", [
    ("Mon Jan 02 15:04:05 +0000 2023", "2023-01-02 15:04:05"), ("tue FEB 29 00:00:00 +0000 2024", "2024-02-29 00:00:00"),
    ("Mon Jan 02 5:04:05.25 +0000 2023", "2023-01-02 05:04:05"), ("Mon Feb 30 15:04:05 +0000 2023", None),
    ("Mon Jan 02 15:04:05 +0100 2023", None), ("Xxx Jan 02 15:04:05 +0000 2023", None), ("", None), (None, None),
    ("2023-01-02", None)])
def test_created_at(spark, text, expected):
    row = spark.createDataFrame([(text,)], "s STRING").select(
        parse_created_at(F.col("s")).cast("string").alias("v")).first()
    assert row.v == expected


def test_json_and_time_round_trips(spark):
    frame = spark.createDataFrame([(["a", 'b"'], dt.datetime(2024, 1, 2, 3, 4, 5))], "a ARRAY<STRING>, t TIMESTAMP")
    row = frame.select(json_to_array(array_to_json(F.col("a"))).alias("a"), rfc3339(F.col("t")).alias("s"),
                       from_rfc3339(rfc3339(F.col("t"))).alias("t")).first()
    assert (row.a, row.s, row.t) == (["a", 'b"'], "2024-01-02T03:04:05Z", dt.datetime(2024, 1, 2, 3, 4, 5))


def test_the_same_error_whole_and_cut(spark, tmp_path):
    broken = ["no array here", "a = [1, 2", 'a = [{"tweet": {"id_str": "1"}}', '[{"x": [1]}', "[1, 2] and ]", "[[1]", "a = "]
    for i, text in enumerate(broken):
        (tmp_path / f"{i}.js").write_text(text)
    files = A.scan_archives(spark, str(tmp_path))
    whole, cut = ({r.job_id: r.error for r in A.ingest(files, RUN, job_name(), chunk_chars=n).bad_archives.collect()} for n in (1000, 1))
    assert whole == cut and len(whole) == len(broken)


def test_files_of_one_name_are_jobs_of_their_own(spark, tmp_path):
    for place in ("u1/posts.js", "u2/posts.js", "u2/posts.txt"):
        (tmp_path / place).parent.mkdir(exist_ok=True)
        (tmp_path / place).write_text(js(FULL))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(str(tmp_path))
    assert A.ingest(files, RUN).posts.select("job_id").distinct().count() == 3


@pytest.fixture
def long_folder(tmp_path, spark):
    """Files around a limit of 2,000 bytes, which also is the binaryFile source's own, so their bytes can't come in a row."""
    rng = random.Random(3)
    many = [post(str(i), f"text {i} " + "".join(rng.choices("abcdefgh", k=40))) for i in range(200)]
    files = {"short.js": js(post("900", "short")), "long name+1.js": js(*many), "long.zip": zipped(data__tweets_js=js(*many)),
             "both.zip": zipped(data__tweets_js=js(*many[:100]), data__tweets_part1_js=js(*many[100:])),
             "cut.zip": zipped(data__tweets_js=js(*many))[:-30], "junk.js": "words " * 1000}
    for name, body in files.items():
        (tmp_path / name).write_bytes(body if isinstance(body, bytes) else body.encode())
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "2000")
    yield str(tmp_path)
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_files_above_the_row_limit(spark, long_folder):
    files = A.scan_archives(spark, long_folder)
    carried = {r.path.rsplit("/", 1)[1]: r.has for r in files.select("path", F.col("content").isNotNull().alias("has")).collect()}
    assert len(carried) == 6 and [n for n, has in carried.items() if has] == ["short.js"]
    for all_parts, both in ((False, 100), (True, 200)):
        read = A.ingest(files, RUN, F.element_at(F.split("path", "/"), -1), all_parts=all_parts, chunk_chars=3000)
        counts = {r.job_id: r["count"] for r in read.posts.groupBy("job_id").count().collect()}
        assert counts == {"short.js": 1, "long name+1.js": 200, "long.zip": 200, "both.zip": both}
        bad = {r.job_id: r.error for r in read.bad_archives.collect()}
        assert set(bad) == {"cut.zip", "junk.js"} and bad["cut.zip"].startswith(S.ERROR_PREFIX + S.ERROR_ZIP)


def test_long_files_equal_short_ones(spark, long_folder):
    """The same rows, whether a file's bytes come with its row or the task opens it."""
    key = ["path", "member", "pos", "tweet"]
    opened = A.parse_pieces(A.read_pieces(A.scan_archives(spark, long_folder))).select(*key).collect()
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", str(1 << 30))
    carried = A.parse_pieces(A.read_pieces(A.scan_archives(spark, long_folder))).select(*key).collect()
    by = lambda r: (r.path, r.member or "", r.pos or 0)
    assert sorted(opened, key=by) == sorted(carried, key=by) and len(opened) > 500


def test_the_limit_is_pushed_into_the_source(spark, long_folder):
    plan = A.scan_archives(spark, long_folder)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("PushedFilters: [IsNotNull(length)") == 2 or plan.count("LessThanOrEqual(length,2000)") == 1


def test_a_missing_long_file_is_a_bad_archive(tmp_path):
    [piece] = read_path(str(tmp_path / "none.zip"))
    assert piece["error"].startswith(S.ERROR_OPEN)


def test_a_long_member_is_read_in_blocks():
    """No read asks for much more than a block, and the pieces held stay near the cut, however long the file is."""
    class Watched(io.BytesIO):
        most = 0

        def read(self, size=-1):
            made = super().read(size)
            self.most = max(self.most, len(made))
            return made

    body = (HEAD + "[" + ",".join(json.dumps(post(str(i), "x" * 500)) for i in range(60_000)) + "]").encode()
    for stream in (Watched(body), Watched(zipped(data__tweets_js=body))):
        sizes = [len(p["js"]) for p in read_archive(stream, chunk_chars=1 << 20)]
        assert sum(sizes) > 30_000_000 and max(sizes) < 3 << 20 and stream.most <= BLOCK_BYTES


class Given:
    """In place of a table of files: takes the function that a task runs."""

    def select(self, *_):
        return self

    def mapInArrow(self, run, _):  # noqa: N802
        return run


def one_batch(count, value, names):
    """One Arrow batch of `count` rows."""
    rows = [value(i) for i in range(count)]
    return pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in rows])


def test_pieces_leave_a_task_in_small_batches(monkeypatch):
    """However many files come at once, their texts are not held together."""
    monkeypatch.setattr(A, "BATCH_BYTES", 1000)
    body = b'x = [{"tweet": {"id_str": "1", "full_text": "' + b"w" * 300 + b'"}}];'
    files = one_batch(40, lambda i: (f"f{i}", body), ["path", "content"])
    out = list(A.read_pieces(Given())(iter([files])))
    assert max(sum(len(t) for t in b.column("js").to_pylist()) for b in out) < 1000 + len(body)
    assert [(r["path"], r["js"], r["error"]) for b in out for r in b.to_pylist()] == [
        (f"f{i}", body.decode(), None) for i in range(40)]


def test_zipped_files_leave_a_task_in_small_batches(monkeypatch):
    monkeypatch.setattr(A, "BATCH_BYTES", 1000)
    bodies = [f"[{i}]" + "".join(map(chr, range(33, 33 + i))) for i in range(60)]
    given = one_batch(60, lambda i: (f"j/{i}", i, bodies[i]), ["path", "part", "body"])
    out = list(_zip_batches(iter([given])))
    assert max(b.num_rows for b in out) < 10
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["path"] for r in rows] == [f"j/{i}" for i in range(60)]
    assert [next(read_archive(r["content"]))["js"] for r in rows] == [b if i % 3 < 2 else None for i, b in enumerate(bodies)]


def test_zipped_members_go_through_no_pandas_batches(spark):
    """A frame of pandas would hold the objects of a whole batch, twice as both steps run in one task."""
    plan = catalog.queries()["archive_zip_member"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.lower().count("mapinarrow") >= 2 and "mapinpandas" not in plan.lower()
