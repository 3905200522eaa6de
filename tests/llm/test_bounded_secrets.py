"""Layers of long texts are looked at as those of short ones."""

import base64

from tidewave.llm import secrets as S


def test_what_is_found_does_not_depend_on_the_size_of_the_text(spark):
    run = base64.b64encode(b"password = hunter2hunter2 and 30 m--").decode()
    hidden = f"%{'25' * 39}{ord(run[0]):02x}{run[1:]}%{'25' * 40}41"
    # in long texts many layers were resolved in one pass, which skips the one that shows the secret
    padding = "x" * 60_000 + "%" + "25" * 160 + "41" + "y" * 1_000
    docs = [(0, f"See, {hidden}, there"), (1, f"See {hidden} {padding}")]
    limits = S.Limits(letters=1_000_000, times=8)
    assert not [s for _, s in S.find_secrets(docs[1][1], limits)[1] if s[0] == "assign"]
    rows = S.scan_secrets(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: "assign:" in r.layers for r in rows} == {0: True, 1: True}
    assert S.scan_secrets.__defaults__[0].letters is None and S.redact_secrets.__defaults__[0].letters is None
