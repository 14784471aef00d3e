"""The workspace from ingest to export."""

import pytest

from clausewright import schemas
from clausewright.api import Workspace
from clausewright.sources import documents as DOC
from tests.test_operators import page


def test_workspace(spark, tmp_path):
    w = Workspace(spark, str(tmp_path))
    old = [("RBI/2020-21/1\nMaster Direction on reports", False), ("(a) The bank shall report within 30 days", False), ("(c) only the old text has this clause", False)]
    new = [("RBI/2021-22/1\nMaster Direction on reports", False), ("(a) The bank shall report within 15 days", False)]
    taken = w.ingest_pages(spark.createDataFrame([page("O", "old", old), page("N", "new", new)], schemas.PAGES))
    assert {r.document_id: r.circular_number for r in taken.collect()} == {"O": "RBI/2020-21/1", "N": "RBI/2021-22/1"}
    done = w.start("C", "O", "N").first()
    assert (done.status, done.total_changes) == ("completed", w.changes("C").count())
    first = w.changes("C", change_type="MODIFIED", search="15 DAYS").first()
    assert first.category == "C05" and first.review_status == "PENDING"
    assert w.review("C", first.change_id, "ACCEPTED", "ok").first().review_status == "ACCEPTED"
    assert w.changes("C", review_status="ACCEPTED").count() == 1
    assert b"Timeline Change" in w.export_csv("C") and w.export_xlsx("C")[:2] == b"PK" and '"C"' in w.export_json("C")
    with pytest.raises(LookupError):
        w.review("C", "CHG-9999", "ACCEPTED")
    with pytest.raises(ValueError):
        w.start("D", "O", "?")
    assert [r.status for r in w.comparisons().orderBy("comparison_id").collect()] == ["completed", "failed"]
    log = w._read("comparisons", schemas.COMPARISONS).where("comparison_id = 'C'").orderBy("logged_at").collect()
    assert [(r.current_stage, r.progress) for r in log] == [("extraction", 5.0), ("parsing", 15.0), ("alignment", 30.0), ("classification", 55.0), ("saving", 95.0), ("completed", 100.0)]
    assert [r.completed_at is None for r in log] == [True] * 5 + [False] and done.created_at == log[0].created_at
    shown = w.dashboard("C")
    assert [(r.name, r.share) for r in shown["bars"].where("category = 'C05'").collect()] == [("Timeline Change", 0.5)] and shown["cards"].count() == 1
    assert w.statistics("C").first().total == done.total_changes and w.impact_heatmap("C").count() >= 1


def test_files_that_cannot_be_read_are_refused(spark, tmp_path):
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "good.pdf").write_bytes(b"good")
    with pytest.raises(FileNotFoundError):
        DOC.scan_versions(spark, str(tmp_path / "files"))
    (tmp_path / "files" / "bad.pdf").write_bytes(b"bad")
    assert DOC.scan_versions(spark, str(tmp_path / "files")).count() == 2

    def extractor(data):
        if data == b"bad":
            raise ValueError("no PDF")
        return [{"spans": [[[{"text": "Master Direction on reports", "size": 11.0, "font": "A"}]]]}]

    w = Workspace(spark, str(tmp_path / "w"))
    taken, refused = w.ingest(str(tmp_path / "files"), "old", extractor)
    assert [r.filename for r in taken.collect()] == ["good.pdf"] and [(r.filename, r.reason) for r in refused.collect()] == [("bad.pdf", "could not be read")]
    assert w.pages().count() == 1 and DOC.find_document(w.documents(), DOC.scan_files(spark, str(tmp_path / "files")), taken.first().document_id).first().path.endswith("good.pdf")
