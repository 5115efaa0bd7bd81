import csv
import io
import random

from ledgerloom.sources.records import fields, read_table, records


def test_records_equal_a_plain_reader(spark, tmp_path):
    """Small byte ranges, quoted line breaks, doubled and stray quotes, empty lines."""
    draw = random.Random(5)
    folder = tmp_path / "in"
    folder.mkdir()
    want = {}
    for n in range(3):
        out = io.StringIO()
        for _ in range(80):
            cells = ["".join(draw.choice('ab ,;"\n\r\n\'x') for _ in range(draw.randrange(9))) for _ in range(draw.randrange(1, 5))]
            line = ",".join('"' + c.replace('"', '""') + '"' if set(c) & set('",\n\r') or draw.random() < 0.2 else c for c in cells)
            out.write(line + draw.choice(("\n", "\r\n", ',5" pipe\n', ',"x"y"z\n')))
        text = out.getvalue()
        (folder / f"{n}.csv").write_bytes(text.encode())
        want[f"{n}.csv"] = [r for r in csv.reader(io.StringIO(text, newline=""), strict=False)]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (old, "400"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "0")
            df = records(spark, str(folder))
            got = {}
            for r in df.select("file", "line", "text", fields(df.text).alias("cells")).orderBy("file", "line").collect():
                got.setdefault(r.file.rsplit("/", 1)[1], []).append([] if r.text == "" else r.cells)
            assert got == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_tables_with_header(spark, tmp_path):
    text = '\ufeff Nome ;;Valor\n"Maria\nSilva";x;"1;5"\n\n;;\nAna\nJo;y;2;;  \nBia;y;3;extra\n'
    (tmp_path / "a.csv").write_text(text)
    got = [(r.line, r["values"], r.issue) for r in read_table(spark, str(tmp_path / "a.csv"), ";").orderBy("line").collect()]
    assert got == [(2, {"Nome": "Maria\nSilva", "Valor": "1;5"}, None), (6, {"Nome": "Ana"}, None), (7, {"Nome": "Jo", "Valor": "2"}, None), (8, {"Nome": "Bia", "Valor": "3"}, "TOO_MANY_FIELDS")]


def test_an_open_quote_takes_the_rest(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,b\n1,"x\n2,y\n')
    assert [(r.line, r.text) for r in records(spark, str(tmp_path / "a.csv")).orderBy("line").collect()] == [(1, "a,b"), (2, '1,"x\n2,y')]
