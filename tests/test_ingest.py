import json

from brightloom import __main__ as command
from brightloom.operators.store import Store
from brightloom.plans import ingest
from brightloom.sources import filings

DOCS = [
    {"source": "sec_edgar", "source_id": "1", "ticker": "T", "title": "Talco Financial Results Q2 2027", "published_at": "2026-08-01T10:00:00Z", "url": "u1", "period_end": "2026-07-31"},
    {"source": "official_ir", "source_id": "2", "ticker": "T", "title": "Presentation", "published_at": "2026-08-01T12:00:00Z", "url": "u2"},
    {"source": "official_ir", "source_id": "3", "ticker": "T", "title": "Talco financial results: Q2 2027", "published_at": "2026-08-01T13:00:00Z", "url": "u3", "period_end": "2026-07-31"},
    {"source": "x", "source_id": "4", "ticker": "U", "title": "Weather", "published_at": None, "url": "u4"}, {"source": "x", "source_id": "5", "title": "Earnings", "url": "u5"},
]
LIST = "title_patterns: [results]\ncompanies:\n  - {ticker: T, name: Talco, cik: 1}\n  - {ticker: U, name: Umco, cik: 2}\n"


def test_runs_are_incremental(spark, tmp_path, capsys):
    (tmp_path / "d.json").write_text(json.dumps(DOCS))
    (tmp_path / "w.yaml").write_text(LIST)
    companies = filings.watchlist(spark, str(tmp_path / "w.yaml"))
    docs = filings.read_disclosures(spark, str(tmp_path / "d.json"))
    store = Store(spark, f"file://{tmp_path}/state")
    told = lambda o: {r["document_key"]: r["outcome"] for r in o.collect()}
    first = {"sec_edgar:1": "new", "official_ir:2": "new", "official_ir:3": "mirror", "x:4": "not_results", "x:5": "unlisted"}
    outcomes, formed = ingest.run(docs, companies, store, "2026-08-02T00:00:00+00:00", dry=True)
    assert told(outcomes) == first and store.read("documents") is None and formed.count() == 1
    outcomes, formed = ingest.run(docs, companies, store, "2026-08-02T00:00:00+00:00")
    assert told(outcomes) == first and [(r["event_id"], r["document_keys"]) for r in formed.collect()] == [("T_2026-07-31_Q2", ["sec_edgar:1", "official_ir:2"])]
    (tmp_path / "e.json").write_text(json.dumps([*DOCS, {"source": "third_party_transcript", "source_id": "9", "ticker": "T", "title": "Talco Transcript Q2 2027", "published_at": "2026-08-03", "period_end": "2026-07-31", "url": "u9"}]))
    outcomes, formed = ingest.run(filings.read_disclosures(spark, str(tmp_path / "e.json")), companies, store, "2026-08-04T00:00:00+00:00")
    again = told(outcomes)
    assert again["sec_edgar:1"] == again["official_ir:2"] == "seen" and again["third_party_transcript:9"] == "new" and formed.first()["documents"] == 3
    outcomes, formed = ingest.run(docs.limit(0), companies, store, "2026-08-05T00:00:00+00:00", ["U"])
    assert outcomes.count() == 0 and formed.count() == 0 and store.read("events").count() == 1
    command.main(["--watchlist", str(tmp_path / "w.yaml"), "--fixture", str(tmp_path / "d.json"), "--tickers", "t", "--at", "2026-08-02T00:00:00+00:00", "--dry-run"])
    lines = [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]
    assert lines == [{"outcome": "mirror", "documents": 1}, {"outcome": "new", "documents": 2}, {"events": 1, "at": "2026-08-02T00:00:00+00:00"}]
