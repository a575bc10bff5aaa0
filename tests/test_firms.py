"""Organisations under several names, by cases and by their edge cases."""

from kgloom.operators import firms as C

FIRM = "project_id string, kind string, seq long, name string, norm string"


def test_company_variants(spark):
    rows = [("p", "company", 1, "Acme"), ("p", "company", 2, "Acme Inc."), ("p", "company", 3, " Acme Electronics Co., Ltd. "), ("p", "company", 4, "Acme Display"), ("p", "company", 5, "Global commercial office"), ("p", "company", 6, "AEMS Global Commercial Office")]
    rows += [("p", "company", 7, "General"), ("p", "company", 8, "General Electronics"), ("p", "applicant", 9, "Acme"), ("q", "company", 10, "Acme Systems"), ("q", "company", 11, "Acme Technologies"), (None, None, 12, "Acme"), ("p", "company", 13, ""), ("p", "company", 14, None), ("p", "company", 15, "--"), ("p", "company", 16, "!!")]
    got = {(r.project_id, r.kind, r.name): r.canonical for r in C.company_variants(spark.createDataFrame([(*r, "clash") for r in rows + rows[:3]], FIRM)).collect()}
    acme, office = "Acme Electronics Co., Ltd.", "AEMS Global Commercial Office"
    assert got == {
        ("p", "company", "Acme"): acme, ("p", "company", "Acme Inc."): acme, ("p", "company", acme): acme, ("p", "company", "Acme Display"): "Acme Display",
        ("p", "company", "Global commercial office"): office, ("p", "company", office): office, ("p", "company", "General"): "General", ("p", "company", "General Electronics"): "General Electronics",
        ("p", "applicant", "Acme"): "Acme", ("q", "company", "Acme Systems"): "Acme Systems", ("q", "company", "Acme Technologies"): "Acme Technologies", ("", "", "Acme"): "Acme", ("p", "company", "--"): "--", ("p", "company", "!!"): "!!",
    }


def test_no_firms(spark):
    assert C.company_variants(spark.createDataFrame([], FIRM)).count() == 0
