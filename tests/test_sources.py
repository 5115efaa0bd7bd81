from datetime import date, datetime

from pyspark.sql import functions as F

from ledgerloom.sources.export import summary_long, write_csv
from ledgerloom.sources.ofx import read_ofx
from ledgerloom.streaming import decisions

OFX = """OFXHEADER:100
<OFX><BANKTRANLIST><DTSTART>20260101120000[-3:BRT]<DTEND>20260131
<STMTTRN><TRNTYPE>DEBIT<DTPOSTED>20260105<TRNAMT>-12,50<FITID>a1<MEMO>PIX ENVIADO</STMTTRN>
<STMTTRN><TRNTYPE>CREDIT
<DTPOSTED>20260107120000
<TRNAMT>7.25
<NAME>Maria
<STMTTRN><DTPOSTED>99999999<TRNAMT>x</STMTTRN>
</BANKTRANLIST><LEDGERBAL><BALAMT>100.00</LEDGERBAL></OFX>"""


def test_ofx(spark, tmp_path):
    (tmp_path / "a.ofx").write_text(OFX)
    (tmp_path / "b.ofx").write_text("nothing")
    got = [(r.row, r.date, r.amount, r.direction, r.fitid, r.memo, r.name, r.period_end, r.ledger_balance) for r in read_ofx(spark, str(tmp_path)).orderBy("row").collect()]
    end = date(2026, 1, 31)
    assert got == [(0, date(2026, 1, 5), -1250, "DEBIT", "a1", "PIX ENVIADO", None, end, 10000), (1, date(2026, 1, 7), 725, "CREDIT", None, None, "Maria", end, 10000), (2, None, None, None, None, None, None, end, 10000)]


def test_export(spark, tmp_path):
    df = spark.createDataFrame([('a"b', None), ("x", 1)], "t string, n int").coalesce(1)
    write_csv(df, str(tmp_path / "out"))
    text = b"".join(p.read_bytes() for p in (tmp_path / "out").glob("part*"))
    assert text == b'\xef\xbb\xbf"t";"n"\r\n"a""b";""\r\n"x";"1"\r\n'
    assert sorted(map(tuple, summary_long(df, {"rows": F.count("*"), "sum": F.sum("n")}).collect())) == [("rows", 2), ("sum", 1)]


def test_decision_stream(spark, tmp_path):
    source, table, checkpoint = (tmp_path / x for x in ("in", "table", "check"))
    source.mkdir()
    for n, lines in enumerate((['{"key":"a","updated_ts":"2026-01-01T00:00:00Z","state":"ACTIVE"}', '{"key":"b","updated_ts":"2026-01-03T00:00:00Z","state":"ACTIVE"}'], ['{"key":"a","updated_ts":"2026-01-01T00:00:00Z","state":"DELETED"}', '{"key":"b","updated_ts":"2026-01-02T00:00:00Z","state":"DELETED"}'])):
        (source / f"{n}.json").write_text("\n".join(lines))
        decisions.merge_new_files(spark, str(source), str(table), str(checkpoint))
    got = sorted((r.key, r.updated_ts, r.state) for r in decisions.current(spark, str(table)).collect())
    assert got == [("a", datetime(2026, 1, 1), "DELETED"), ("b", datetime(2026, 1, 3), "ACTIVE")]
