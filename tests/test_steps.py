"""The request stream: guard before plan, streams equal tables."""

import json

from hushlake.streaming import steps


def element(id_, role, label, **more):
    return {"id": id_, "role": role, "label": label, **more}


REQUESTS = [
    {"request_id": 1, "task": "fill the form", "profile_keys": ["EMAIL"], "elements": [element(1, "textbox", "Email", sensitive="EMAIL")]},
    {"request_id": 2, "task": "fill it", "elements": [element(1, "textbox", "Name", value="card 4111 1111 1111 1111")]},
    {"request_id": 3, "task": "What is on this page?", "elements": []},
    {"request_id": 4, "task": "my mail is ⟦PROFILE.EMAIL⟧", "elements": [element(1, "textbox", "x", value="⟦EMAIL_1⟧")]},
]


def test_stream_equals_table(spark, tmp_path):
    lines = [json.dumps(r, ensure_ascii=False) for r in REQUESTS] + ["not json"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("\n".join(lines), encoding="utf-8")
    table = steps.answered(steps.parsed(spark.read.text(str(tmp_path / "in")))).collect()
    got = {r.request_id: (r.status, r.action, r.text) for r in table}
    assert got == {1: (200, "type", "⟦PROFILE.EMAIL⟧"), 2: (422, None, None), 3: (200, "done", "describe"), 4: (200, "done", "filled")}
    leak = next(r for r in table if r.request_id == 2).incidents
    assert [(i.type, i.path) for i in leak] == [("CARD", "elements[0].value")]
    stream = steps.answered(steps.parsed(spark.readStream.text(str(tmp_path / "in"))))
    q = stream.writeStream.outputMode("append").format("memory").queryName("answered").start()
    q.processAllAvailable()
    q.stop()
    assert {r.request_id: (r.status, r.action, r.text) for r in spark.table("answered").collect()} == got
