"""Owners by their profiles, one case for each rule."""

import json

from loomwork.operators import classify


def test_owners(spark):
    row = lambda role, pub=None, user="1", inner=None: {"user_id": user, "publication_id": pub, "role": role, "publication": {"id": inner}}
    cases = [
        ({"id": "1", "hasPosts": True, "publicationUsers": [row("Admin", "7")]}, (1, "7", "admin")),
        ({"id": "1", "hasPosts": False, "publicationUsers": [row("admin", "7")]}, (0, "7", "admin")),
        ({"id": "1", "hasPosts": True, "publicationUsers": [row(" admin ", "7")]}, (0, "7", " admin ")),
        ({"id": "1", "hasPosts": True, "publicationUsers": [row("editor"), row("", "77")]}, (0, "77", "editor")),
        ({"id": "1", "hasPosts": True, "primaryPublication": {"id": "5"}, "publicationUsers": [row("admin"), row("admin", "8")]}, (1, "5", "admin")),
        ({"id": "1", "hasPosts": True, "publicationUsers": [row("contributor", "3"), row("admin", None, inner="9"), row("x", "4")]}, (1, "9", "contributor")),
        ({"id": "1", "hasPosts": True, "publicationUsers": [row("admin", "7", user="2")]}, (0, None, None)),
        ({"hasPosts": True, "publicationUsers": [row("admin", "7", user="2")]}, (1, "7", "admin")),
        ({}, (0, None, None)),
        (None, (0, None, None)),
    ]
    df = spark.createDataFrame([(k, None if c is None else json.dumps(c)) for k, (c, _) in enumerate(cases)], "k long, payload string")
    found = classify.owners(df).orderBy("k").collect()
    assert [(r.is_owner, r.publication_id, r.role) for r in found] == [want for _, want in cases]
