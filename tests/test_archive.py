import email
import email.policy
import glob
import os
import re
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from postbag import catalog_files
from postbag.operators import archives, contacts, entities, messages
from postbag.plans.search import SearchSpec, search
from postbag.sinks import export, shared
from postbag.sinks.shared import write_files
from postbag.sources import mbox, side
from postbag.streaming import ingest

MBOX = """From - Mon Jan 01 00:00:00 2001
From: "Ann Lee" <ann@x.org>
To: bob@y.org, "Cy" <cy@z.org>
Date: Mon, 01 Jan 2001 10:00:00 +0000
Subject: Plans
Message-ID: <1@x>
List-Post: <mailto:l@x.org>
Content-Type: multipart/mixed; boundary="b"

--b
Content-Type: multipart/alternative; boundary="c"

--c
Content-Type: text/plain; charset=utf-8

Hello plain
>From here
--c
Content-Type: text/html

<p>Hello <b>html</b></p>
--c--
--b
Content-Type: text/plain
Content-Disposition: attachment; filename="note.txt"
Content-Transfer-Encoding: base64

bm90ZSB0ZXh0
--b--

From - Tue Jan 02 00:00:00 2001
From: bob@y.org
To: ann@x.org
Subject: =?utf-8?q?Caf=C3=A9?=

No date here
"""


@pytest.fixture(scope="module")
def mail(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("mail")
    (d / "inbox").write_text(MBOX)
    return mbox.read_mbox(spark, str(d)).cache()


def test_mbox(mail):
    a, b = mail.orderBy("date", ascending=False).collect()
    assert a.subject == "Plans" and a["from"][0].email == "ann@x.org" and [x.email for x in a.to] == ["bob@y.org", "cy@z.org"]
    assert "Hello plain" in a.body and "\nFrom here" in a.body and "html" in a.text_html
    assert a.attachments[0].filename == "note.txt" and a.attachments[0].text == "note text" and a.attachments[0].size == 9
    assert b.subject == "Café" and b.hacky_date and b.date.year == 1960
    assert len(a.doc_id) == 64 and a.doc_id != b.doc_id


def test_mbox_round_trip(spark, mail, tmp_path):
    out = mail.withColumn("annotation", F.lit("")).withColumn("label_names", F.expr("cast(array() as array<string>)"))
    export.write_mbox(out, str(tmp_path / "out"))
    again = mbox.read_mbox(spark, str(tmp_path / "out"))
    key = lambda df: sorted((r.subject, r["from"][0].email, r.body.strip()) for r in df.collect())
    assert key(again) == key(mail)


def test_one_mailbox_is_many_tasks(spark, tmp_path):
    """A folder of 20 MB is written as several files and read by several tasks, whatever the cuts."""
    rows = spark.range(4000).selectExpr("'big' as folder", "timestamp '2001-01-01' + make_interval(0, 0, 0, 0, 0, id % 50) as date", "concat('n', id) as subject", "concat('<', id, '@x>') as message_id", "concat('From here ', id, '\nFrom there\n', repeat(concat('line ', id, '\n'), 500)) as body", "'' as annotation", "cast(array() as array<string>) as label_names")
    for n in ("from", "to", "cc", "bcc"):
        rows = rows.withColumn(n, F.expr("array(named_struct('name', cast(null as string), 'email', 'a@b'))"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if it were large
    export.write_mbox(rows, str(tmp_path / "out"))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(list((tmp_path / "out").glob("folder=big/part-*"))) > 1
    whole = tmp_path / "one"
    whole.mkdir()
    (whole / "big").write_bytes(b"".join(f.read_bytes() for f in sorted((tmp_path / "out").glob("folder=big/part-*"))))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = {(r.subject, r.body.rstrip("\n")) for r in rows.collect()}
    try:
        for size in ("100000000", "1000003"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            for path in ("out", "one"):
                got = mbox.read_mbox(spark, str(tmp_path / path))
                assert {(r.subject, r.body.rstrip("\n")) for r in got.collect()} == want
        assert mbox.records(spark, str(whole)).rdd.getNumPartitions() > 10
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_records_at_a_files_ends(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"Subject: before any separator\n\nx\n\nFrom a b\nSubject: two\r\n\r\n>From y\r\n\nFrom From c\nFrom: z@x\nSubject: three\n\nFrom")
    (tmp_path / "b").write_bytes(b"")
    (tmp_path / "c").write_bytes(b"\n\n")
    got = {r.subject.strip(): r.body.strip() for r in mbox.read_mbox(spark, str(tmp_path)).collect()}
    assert got == {"before any separator": "x", "two": "From y", "three": "From"}


def _by_library(raw: bytes) -> dict:
    return mbox._row(email.message_from_bytes(raw, policy=email.policy.compat32), "f")


def test_plain_mail_is_cut_without_the_library(monkeypatch):
    """Plain mail as the writer makes it needs no parser of all mail, and its rows are the same."""
    head = b'From: "Ann#1 Lee" <Ann#1@x.org>\nTo: "B c" <d.e@f.g>, h@i.j\nDate: Mon, 01 Jan 2001 10:00:00 -0500\nSubject: hi \nMessage-ID: <1@x>\n'
    file = b"Content-Type: application/octet-stream\nContent-Disposition: attachment; filename*=utf-8''a%20%C3%A9.pdf\nContent-Transfer-Encoding: base64\n\naGVs\nbG8=\n"
    inner = b'Content-Type: multipart/alternative; boundary="=_t"\n\n--=_t\nContent-Type: text/plain; charset="utf-8"\n\ncaf\xc3\xa9\n--=_tt\n--=_t\nContent-Type: text/html\n\n<p>x</p>\n--=_t--\n'
    mails = [head + b"\nbody\n", head + b'Content-Type: multipart/mixed; boundary="=_m"\n\nThis\n--=_m\n' + inner + b"--=_m \n" + file + b"--=_m--\n"]
    want = [_by_library(m) for m in mails]
    monkeypatch.setattr(email, "message_from_bytes", None)
    assert [mbox.parse_message(m, "f") for m in mails] == want
    assert want[1]["attachments"][0]["content"] == b"hello" and want[1]["attachments"][0]["filename"] == "a é.pdf" and "=_tt" in want[1]["body"]


@pytest.mark.parametrize("raw", [
    b"Subject: a\n folded\n\nx\n", b"Subject: =?utf-8?q?Caf=C3=A9?=\n\nx\n", b"To: a@b,c@d\nTo: e@f\n\nx\n", b"From: a..b@c\n\nx\n", b"Subject: caf\xc3\xa9\n\nx\n", b"Subject: x", b"no head\n\nx\n", b"Subject: x\r\n\r\ny\r\n",
    b'Content-Type: multipart/mixed; boundary="b"\n\n--b\n\nx\n--b\n\nunclosed\n', b'Content-Type: multipart/mixed; boundary="b"\n\n--b--\n', b"Content-Transfer-Encoding: base64\n\naGV=sbG8=\n", b"Content-Type: text/plain; format=flowed\n\nx\n", b"Content-Type: message/rfc822\n\nSubject: in\n\nx\n",
])
def test_odd_mail_goes_to_the_library(raw):
    assert mbox.parse_message(raw, "f") == _by_library(raw)


def test_texts_are_made_once(spark, mail, tmp_path):
    """The ranges of a mailbox are found on texts that are written, not on ones made for it and made again."""
    made = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: (made.add(1), x)[1], "string").asNondeterministic()
    out = mail.withColumn("body", count("body")).withColumn("annotation", F.lit("")).withColumn("label_names", F.expr("cast(array() as array<string>)"))
    export.write_mbox(out, str(tmp_path / "out"))
    assert made.value == 2


def _letters(spark, n: int):
    """Letters of two folders with dates that repeat, some without one, each with a file."""
    rows = spark.range(n).selectExpr("concat('mail/', id % 2) as folder", "if(id % 17 = 0, null, timestamp '2001-01-01' + make_interval(0, 0, 0, id % 50)) as date", "concat('n', id) as subject", "concat('<', id, '@x>') as message_id", "concat('From here ', id) as body", "'' as annotation", "cast(array() as array<string>) as label_names")
    file = f"array(named_struct('filename', concat(id, '.pdf'), 'content_type', null, 'charset', null, 'size', 1L, 'sha1', null, 'text', null, 'content', cast(subject as binary)))"
    rows = rows.withColumn("id", F.substring("subject", 2, 9)).withColumn("attachments", F.expr(file).cast(mbox.ATTACHMENTS)).drop("id")
    for name in ("from", "to", "cc", "bcc"):
        rows = rows.withColumn(name, F.expr("array(named_struct('name', cast(null as string), 'email', 'a@b'))"))
    return rows


def _read_back(spark, path):
    return sorted((r.subject, r.body.strip(), r.attachments[0].filename, bytes(r.attachments[0].content)) for r in mbox.read_mbox(spark, str(path)).collect())


def _files_under(place) -> int:
    return sum(len(files) for _, _, files in os.walk(place))


def test_a_mailbox_leaves_nothing_but_itself(spark, tmp_path, monkeypatch):
    """Neither packed rows nor shuffles stay beside a written mailbox, and a packed one is read like a plain one."""
    monkeypatch.setitem(shared._FALLBACK, spark.sparkContext.applicationId, f"file://{tmp_path}/held")
    shuffles = lambda: sum(f.startswith("shuffle_") for top in glob.glob(spark.conf.get("spark.local.dir", "/tmp") + "/blockmgr-*") for _, _, files in os.walk(top) for f in files)
    rows, before = _letters(spark, 400), shuffles()
    export.write_mbox(rows.repartition(3, "subject"), str(tmp_path / "plain"))
    export.write_mbox(rows, str(tmp_path / "packed"), compression="gzip")
    assert _files_under(tmp_path / "held") == 0 and shuffles() <= before
    want = [(f"n{i}", f"From here {i}", f"{i}.pdf", f"n{i}".encode()) for i in range(400)]
    assert _read_back(spark, tmp_path / "plain") == _read_back(spark, tmp_path / "packed") == sorted(want)
    size = lambda name, end: sum(f.stat().st_size for f in (tmp_path / name).glob(f"folder=*/part-*{end}"))
    assert 0 < size("packed", ".gz") < size("plain", ".txt") / 4


def test_a_mailbox_in_rounds_is_in_order(spark, tmp_path, monkeypatch):
    """Rounds by date lose no message, also none without a date, and files are numbered in order of date."""
    monkeypatch.setattr(export, "ROUND_BYTES", 100)
    rows = _letters(spark, 400)
    (tmp_path / "out" / "folder=old").mkdir(parents=True)
    (tmp_path / "out" / "folder=old" / "part-x").write_text("From - x\nSubject: old\n\nold\n")
    export.write_mbox(rows, str(tmp_path / "out"))
    assert len(_read_back(spark, tmp_path / "out")) == 400 and len({r[0] for r in _read_back(spark, tmp_path / "out")}) == 400
    for box in ("mail%2F0", "mail%2F1"):
        files = sorted((tmp_path / "out" / f"folder={box}").glob("part-*"))
        dates = [email.utils.parsedate_to_datetime(d) for f in files for d in re.findall(r"(?m)^Date: (.*)$", f.read_text())]
        assert len(files) > export.ROUNDS and dates == sorted(dates) and len(dates) > 150
    same = rows.withColumn("date", F.lit(None).cast("timestamp"))
    export.write_mbox(same, str(tmp_path / "out"))
    assert len(_read_back(spark, tmp_path / "out")) == 400


def test_lines_of_a_message_are_brought_together_as_numbers(spark):
    """People and files of messages take one shuffle each, of keys and not of names."""
    d = "/root/testdata/sf0.001"
    for rows, wide in ((catalog_files.recipients(spark, d, together=True), "s_name"), (catalog_files.attachments(spark, d, together=True), "concat")):
        plan = rows.groupBy("doc_id").agg(F.collect_list(F.struct(*rows.columns[1:])).alias("x"))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1
        assert wide not in plan[plan.index("Exchange hashpartitioning") :].split("BroadcastExchange")[0]


def test_summaries_multiply_no_row_by_role(spark):
    docs = spark.createDataFrame([(1, 1, "sent"), (1, 1, "received"), (1, 1, "sent"), (1, 2, "received"), (None, 2, "sent"), (2, 3, "received_from_owner"), (2, None, "sent")], "contact_id long, doc_id long, role string")
    dated = spark.sql("select * from values (1L, timestamp'2001-01-01'), (1L, timestamp'2001-01-02'), (2L, timestamp'1960-01-01'), (3L, cast(null as timestamp)) as t(doc_id, date)")
    out = contacts.summaries(docs, dated)
    got = {r.contact_id: (r.sent, r.received, r.received_from_owner, r.first and r.first.day, r.last and r.last.day) for r in out.collect()}
    assert got == {1: (1, 2, 0, 1, 2), None: (1, 0, 0, None, None), 2: (0, 0, 1, None, None)}
    assert "Expand" not in out._jdf.queryExecution().executedPlan().toString()


def test_unseen(spark):
    old = spark.createDataFrame([("a", "f", 1), ("a", "f", 5), (None, "f", 3)], "account string, folder string, uid long")
    new = spark.createDataFrame([("a", "f", 4), ("a", "f", 6), ("a", "g", 1), (None, "f", 3), (None, "f", 9), ("a", "f", None)], "account string, folder string, uid long")
    keys = ["account", "folder"]
    got = mbox.unseen(new, mbox.last_seen(old, keys, "uid"), keys, "uid").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("a", "f", 6), ("a", "g", 1), (None, "f", 9), ("a", "f", None)], key=repr)
    assert mbox.unseen(new, mbox.last_seen(old.where("false"), keys, "uid"), keys, "uid").count() == 6


def _eml(*files, plain=None, html=None):
    m = EmailMessage()
    m["From"], m["Subject"], m["Date"] = "ann@x.org", f"{plain is not None} {html is not None} {len(files)}", "Mon, 01 Jan 2001 10:00:00 +0000"
    if plain is not None:
        m.set_content(plain)
    if html is not None:
        (m.set_content if plain is None else m.add_alternative)(html, subtype="html")
    for name, kind, data in files:
        m.add_attachment(data, *kind.split("/"), filename=name) if isinstance(data, bytes) else m.add_attachment(data, filename=name)
    return b"From - Mon Jan 01 00:00:00 2001\n" + re.sub(rb"(?m)^(>*From )", rb">\1", m.as_bytes()) + b"\n"


def test_mbox_round_trip_keeps_html_and_attachments(spark, tmp_path):
    inner = EmailMessage()
    inner["Subject"], inner["From"] = "inner", "cy@z.org"
    inner.set_content("inside\nlines\n")
    files = [("a b*+é'.bin", "application/octet-stream", bytes(range(256)) * 5), ("n.txt", "text/plain", b"x\r\nFrom y\n--b\n"), ("empty.pdf", "application/pdf", b""), ("m.eml", "message/rfc822", inner)]
    plain, html = "Hi \u2028From there\nFrom here\n", "<p>From <b>é</b></p>\nFrom html\n"
    kinds = [_eml(*f, plain=p, html=h) for f in ([], files) for p, h in ((plain, None), (None, html), (plain, html))]
    russian = b'From - x\nFrom: r@x\nSubject: koi\nContent-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: text/plain; charset=koi8-r; name="r.txt"\n\n\xd0\xd2\xc9\n--q\nContent-Type: image/png\nContent-Transfer-Encoding: base64\n\niVBO\n--q--\n'
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "box").write_bytes(b"".join([*kinds, russian]))
    first = mbox.read_mbox(spark, str(tmp_path / "in"))
    rows = first.withColumn("annotation", F.lit("")).withColumn("label_names", F.expr("cast(array() as array<string>)"))
    export.write_mbox(rows, str(tmp_path / "out"))
    again = mbox.read_mbox(spark, str(tmp_path / "out"))
    key = lambda df: {r.subject: (r.body.rstrip("\n"), r.has_plain, r.text_html, [tuple(a) for a in r.attachments]) for r in df.collect()}
    want = key(first)
    assert len(want) == 7 and [len(want[s][3]) for s in ("True False 4", "False True 4", "True True 4", "koi")] == [4, 4, 4, 2]
    assert bytes(want["True True 4"][3][0][-1]) == files[0][2] and want["koi"][3][0][5] == "при"
    assert key(again) == want


def test_mbox_of_rows_without_parts_or_content(spark, tmp_path):
    bare = spark.sql("select 'f' as folder, timestamp '2001-01-01' as date, 's' as subject, cast(null as string) as message_id, 'b' as body, '' as annotation, cast(array() as array<string>) as label_names")
    for n in ("from", "to", "cc", "bcc"):
        bare = bare.withColumn(n, F.expr("array(named_struct('name', cast(null as string), 'email', 'a@b'))"))
    export.write_mbox(bare, str(tmp_path / "a"))
    odd = bare.withColumn("text_html", F.lit("<p>")).withColumn("attachments", F.expr("array(named_struct('filename', null, 'content_type', null, 'charset', null, 'size', 1, 'sha1', null, 'text', 't', 'content', null))").cast(mbox.ATTACHMENTS))
    export.write_mbox(odd, str(tmp_path / "b"))
    a, b = (mbox.read_mbox(spark, str(tmp_path / n)).first() for n in "ab")
    assert a.body.strip() == "b" and a.attachments == [] and a.text_html is None
    assert b.body == "b" and b.text_html == "<p>" and bytes(b.attachments[0].content) == b"t"


def test_attached_message_in_base64():
    raw = b'From: a@b\nContent-Type: multipart/mixed; boundary="q"\n\n--q\nContent-Type: message/rfc822\nContent-Transfer-Encoding: base64\n\nU3ViamVjdDogeAoK/w==\n--q--\n'
    assert mbox.parse_message(raw, "f")["attachments"][0]["content"] == b"Subject: x\n\n\xff"


def test_search_on_mail(mail):
    t = {"messages": mail.withColumn("email_source", F.lit("x"))}
    assert search(t, SearchSpec(term="hello")).count() == 1
    assert search(t, SearchSpec(correspondent="cy@z.org", roles=("to",))).count() == 1
    assert search(t, SearchSpec(sender_is="bob@y.org")).count() == 1
    assert search(t, SearchSpec(start="2001-01-01")).count() == 1


def test_contacts(spark):
    a = spark.createDataFrame([("Ann Lee", "ann@x.org"), ("ann", " ANN@x.org"), ("Bob", "b@y"), (None, "c@z")], "name string, email string")
    book = {r.email: r for r in contacts.address_book(a).collect()}
    assert book["ann@x.org"].best_name == "Ann Lee" and book["c@z"].best_name == "c@z"
    r = contacts.resolve(spark.createDataFrame([(1, "Lee, Ann", "new@q"), (2, "x", "b@y"), (3, "nobody", "n@n")], "doc_id int, name string, email string"), contacts.address_book(a)).collect()
    got = {x.doc_id: x.contact_id for x in r}
    assert got[1] == book["ann@x.org"].contact_id and got[2] == book["b@y"].contact_id and got[3] is None


def test_merge_books(spark):
    s = "contact_id int, emails array<string>, names array<string>"
    a = spark.createDataFrame([(1, ["a", "b"], ["A"]), (2, ["c"], ["C"])], s)
    b = spark.createDataFrame([(7, ["b"], ["B"]), (8, ["d"], ["D"])], s)
    assert sorted(tuple(r.emails) for r in contacts.merge_books(a, b).collect()) == [("a", "b"), ("c",), ("d",)]


def test_mailing_lists(spark):
    m = spark.createDataFrame([(1, 5, True), (2, 6, False), (3, 1, False)], "doc_id int, contact_id int, list_post boolean")
    to = spark.createDataFrame([(1, 9), (2, 8), (3, 7)], "doc_id int, contact_id int")
    state = {r.contact_id: r.ml_state for r in contacts.mailing_list_state(m, to, 1).collect()}
    assert state[9] & contacts.SUPER_DEFINITE and state[8] & contacts.DEFINITE and state[7] == 0 and state[5] == contacts.DEFINITE_NOT


def test_redaction_hides_everything_else(spark):
    df = spark.createDataFrame([("The secret of Ann Lee, 42!", ["ann", "lee"])], "t string, allowed array<string>")
    assert df.select(messages.redact(F.col("t"), F.col("allowed")).alias("x")).first().x == "... ...... .. Ann Lee, ..!"


def test_redaction_takes_words_whole(spark):
    """Words and what stands between them, not each character by itself, are looked at."""
    rows = ["Ann\u2014Lee  é7 \U0001d400x\n\t-- a", "", None, "!?"]
    df = spark.createDataFrame([(t, ["é7", "lee"]) for t in rows], "t string, allowed array<string>")
    out = df.select(messages.redact(F.col("t"), F.col("allowed")).alias("x"))
    assert [r.x for r in out.collect()] == ["...\u2014Lee  é7 ..\n\t-- .", "", None, "!?"]
    assert "(?<=" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_labels(spark):
    s = "label_id string, name string"
    got = {r.name: r.label_id for r in messages.merge_labels(spark.createDataFrame([("1", "a"), ("2", "b")], s), spark.createDataFrame([("1", "c"), ("5", "b")], s)).collect()}
    assert got == {"a": "1", "b": "2", "c": "1-other"}
    d = spark.createDataFrame([(1, "x")], "doc_id int, label_id string")
    ids = spark.createDataFrame([(1,), (2,)], "doc_id int")
    more = messages.set_labels(d, ids, "y")
    assert more.count() == 3 and messages.unset_labels(more, ids, "y").count() == 1


def test_lexicon_expansion():
    assert entities.expand_lexicon({"a": "x|{b}", "b": "y {a}", "c": "{b}"})["c"] == "y {a}"
    assert entities.expand_lexicon({"a": "x|{b}", "b": "y"})["a"] == "x|y"


def test_side_files(spark, tmp_path):
    (tmp_path / "book").write_text("--\nAnn Lee\nann@x.org\nA. Lee\n--\nb@y\n")
    got = {r.best_name: (r.names, r.emails) for r in side.read_address_book(spark, str(tmp_path / "book")).collect()}
    assert got == {"Ann Lee": (["Ann Lee", "A. Lee"], ["ann@x.org"]), "b@y": ([], ["b@y"])}
    (tmp_path / "lex").write_text("# c\njoy: happy|glad\nsad: cry\njoy: smile\n")
    assert {r.caption: r.query for r in side.read_lexicon(spark, str(tmp_path / "lex")).collect()} == {"joy": "happy|glad|smile", "sad": "cry"}
    (tmp_path / "nt").write_text('<http://a/1> <http://p#label> "Ann \\"x\\""@en .\n<http://a/1> <http://p#same> <http://b/2> .\n')
    r = side.read_triples(spark, str(tmp_path / "nt"), ["label", "same"]).first()
    assert r.label == ['Ann \\"x\\"'] and r.same == ["http://b/2"]


def test_manifest(spark):
    a = spark.createDataFrame([("x", b"1"), ("y", b"2")], "path string, content binary")
    b = spark.createDataFrame([("x", b"1"), ("y", b"3"), ("z", b"4")], "path string, content binary")
    assert {r.path: r.state for r in export.verify(b, export.manifest(a)).collect()} == {"y": "changed", "z": "added"}


def test_near_ties_and_empty(spark):
    empty = spark.createDataFrame([], "doc_id int, date timestamp, contact_id int")
    assert messages.sessions(empty, ["contact_id"]).count() == 0


def test_stream_drops_repeats(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = spark.sql("select * from values ('a', timestamp '2001-01-01', 'f'), ('a', timestamp '2001-01-01', 'f'), ('b', timestamp '2001-01-02', 'g') as t(uid, date, folder)")
    rows.write.parquet(src)
    ingest.to_table(ingest.new_messages(spark, src, "uid string, date timestamp, folder string"), out, str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(out).count() == 2
    assert os.path.isdir(out)


def test_entity_book_keeps_digits(spark, tmp_path):
    (tmp_path / "book").write_text("--\nRoom 100\nthe 101\n--\n 1 Main St \n")
    rows = sorted((r.display, r.names) for r in side.read_entity_book(spark, str(tmp_path / "book")).collect())
    assert rows == [("1 Main St", ["1 Main St"]), ("Room 100", ["Room 100", "the 101"])]


def test_eml_files(spark, mail, tmp_path):
    m = mail.withColumn("annotation", F.lit("")).withColumn("label_names", F.array().cast("array<string>"))
    write_files(export.eml(m), str(tmp_path / "eml"))
    names = os.listdir(tmp_path / "eml")
    assert sorted(names) == sorted(f"{r.doc_id}.eml" for r in m.collect())
    got = [mbox.parse_message((tmp_path / "eml" / n).read_bytes(), "eml") for n in names]
    plans = next(g for g in got if g["subject"] == "Plans")
    assert plans["to"] == [{"name": None, "email": "bob@y.org"}, {"name": "Cy", "email": "cy@z.org"}]
    assert [a["filename"] for a in plans["attachments"]] == ["note.txt"] and "From here" in plans["body"]


def test_archive_merge_keeps_lexicons_and_edits(spark):
    lex = lambda *n: spark.createDataFrame([(x, "c") for x in n], "name string, caption string")
    m = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, uid string")
    acc = m.select("doc_id", F.lit("x").alias("accession_id"))
    one = {"messages": m.where("doc_id = 1"), "accessions": acc.where("doc_id = 1"), "lexicon": lex("s", "t")}
    got = archives.merge_archives(one, {"messages": m, "accessions": acc, "lexicon": lex("t", "u")}, "new")
    assert sorted(r.name for r in got["lexicon"].collect()) == ["s", "t", "u"]
    assert {r.doc_id: r.accession_id for r in got["accessions"].collect()} == {1: "x", 2: "new"}
    assert [r.bits for r in archives.direction(acc, m, None).collect()] == [1, 1]
