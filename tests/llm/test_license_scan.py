import duckdb
import pytest

import brute
from leaseloom.llm import license_scan as L
from leaseloom.llm import oracle

TEXTS = [
    "Released under the MIT License. mit  license", "the Apache-License, then the general public license", "Licensed under CC BY-NC 4.0.", None, "", "mit",
    "Licensed under the Apache License, Version 2.0.", "mit license " * 50, "license mit license", "general public general public license",
    "Permission is hereby granted, free of charge, to any other person obtaining a copy of this software and associated documentation files"]
ROWS = list(enumerate(TEXTS)) + [(0, TEXTS[0]), (0, TEXTS[1]), (None, TEXTS[0]), (None, TEXTS[0])]


def test_base_places_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "insight_id bigint, detail string").selectExpr("*", "1 as gram", "'x' as label", "2 as digest")
    got = [(r.insight_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in L.scan_licenses(df).collect()]
    assert sorted(got, key=str) == sorted([(i, *brute.base_places(t, L.BASE)) for i, t in ROWS], key=str)


def test_notices_with_a_word_put_in(spark):
    out = {r.insight_id: r for r in L.scan_licenses(spark.createDataFrame(list(enumerate(TEXTS)), "insight_id bigint, detail string")).collect()}
    assert out[2].labels == "cc-by-nc-4.0" and out[6].labels == "apache,apache-2.0" and out[10].labels == "mit" and out[10].base_labels == ""
    assert out[0].score == 1.0 and out[3].score == 0.0 and 0.9 <= out[10].score < 1
    assert all(not r.base_labels or set(r.base_labels.split(",")) <= set(r.labels.split(",")) for r in out.values())


def _labels(spark, texts):
    return [r.labels for r in L.scan_licenses(spark.createDataFrame(list(enumerate(texts)), "insight_id bigint, detail string")).orderBy("insight_id").collect()]


def test_all_rights_reserved_alone(spark):
    assert _labels(spark, ["(c) 2020 Someone. All rights reserved.", "All rights of others are reserved.", "all rights"]) == ["proprietary", "", ""]


def _edited():
    """Each notice with one edit outside the name of its license."""
    texts, wanted = [], []
    for text, label in L.NOTICES:
        words, named = text.split(), L._named(text, label)
        windows = len(words) - 1
        for at in range(windows):
            if not named >> at & 1:
                texts.append(" ".join([*words[:at + 1], "zzz", *words[at + 1:]]))
                wanted.append(label)
        for at in range(1, windows):
            if not named >> (at - 1) & 3:
                texts += [" ".join([*words[:at], "zzz", *words[at + 1:]]), " ".join([*words[:at], *words[at + 1:]])]
                wanted += [label, label]
    return texts, wanted


def _denied():
    """Each notice with a word of denial put in, anywhere but in the reservation of rights."""
    rows = []
    for text, label in L.NOTICES:
        words = text.split()
        rows += [(" ".join(["this text is", *words[:at], "not", *words[at:], "and so on"]), label)
                 for at in range(len(words)) if not text.startswith("all rights reserved") or at == 0]
    return [t for t, _ in rows], [label for _, label in rows]


def test_each_notice_with_one_edit_outside_the_name_of_its_license(spark):
    texts, wanted = _edited()
    assert [(t, label, found) for t, label, found in zip(texts, wanted, _labels(spark, texts), strict=True) if label not in found.split(",")] == []


def test_the_oracle_says_the_same_of_edits_and_denials(spark):
    rows = list(enumerate([*_edited()[0], *_denied()[0], *(t for t in TEXTS if t is not None)]))
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", frame.toPandas())
    want = con.execute(oracle.LICENSE_SCANS).fetchall()
    got = L.scan_licenses(frame.toDF("insight_id", "detail")).select("insight_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score").collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_other_licenses_do_not_pass_for_edits(spark):
    gpl = "licensed under the GNU {} General Public License version {}"
    got = _labels(spark, [
        "Licensed under CC BY-NC 4.0", "Licensed under CC BY-SA 4.0", "Licensed under CC BY 4.0", "Licensed under CC BY-ND 4.0", "Licensed under CC BY-NC-SA 4.0",
        "Licensed under CC BY 3.0", gpl.format("", 3), gpl.format("", 2), gpl.format("", 1), gpl.format("Affero", 3), gpl.format("Lesser", 3),
        "Licensed under the Apache License, Version 1.1", "released under the BSD license"])
    assert got == ["cc-by-nc-4.0", "cc-by-sa-4.0", "cc-by-4.0", "", "", "", "gpl,gpl-3.0", "gpl,gpl-2.0", "gpl", "gpl", "gpl,lgpl", "apache", ""]


def test_denials_get_no_label_of_the_notice(spark):
    texts, notices = _denied()
    found = _labels(spark, texts)
    base = dict(L.BASE)
    for text, label, got in zip(texts, notices, found, strict=True):
        left = {v for k, v in base.items() if k in text}
        # a shorter notice inside it may stand undenied
        left |= {other for whole, other in L.NOTICES if whole in text and f"not {whole}" not in text and f"is not {whole}" not in text}
        assert set(filter(None, got.split(","))) <= left, (text, got)
    assert _labels(spark, [
        "Redistribution and use in source and binary forms, with or without modification, are not permitted.",
        "Permission is hereby not granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "It is not here. This one is licensed under CC BY 4.0.", "never licensed under CC BY 4.0"]) == ["", "", "cc-by-4.0", ""]


def test_a_template_too_long_for_its_bits_is_an_error(spark):
    with pytest.raises(ValueError, match="63 fit"):
        L.templates(spark, notices=((" ".join(f"w{k}" for k in range(65)), "x"),))


def test_no_rows(spark):
    assert L.scan_licenses(spark.createDataFrame([], "insight_id bigint, detail string")).collect() == []
