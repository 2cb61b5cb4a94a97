"""Sources: table layouts, multi-file logs with a stable line order, column text."""

import os

from paths import SF0001
from switchyard.operators import aggregates as A
from switchyard.session import local_fs_path, scratch_path
from switchyard.sources import tables as TB
from switchyard.sources import text as TX


def test_read_table_file_and_folder_layouts(spark):
    single = TB.read_table(spark, "orders", "parquet", SF0001)
    root = scratch_path(spark, "tables")
    single.write.parquet(f"{root}/orders")
    folder = TB.read_table(spark, "orders", "parquet", root)
    assert single.count() == folder.count() > 0
    assert single.schema.simpleString() == folder.schema.simpleString()


def test_first_kv_line_follows_file_order(spark):
    d = local_fs_path(scratch_path(spark, "kv-files"))
    os.makedirs(d)
    # the bigger file sorts later by name: "first" must follow file order, not split size
    with open(os.path.join(d, "a.conf"), "w") as f:
        f.write("jbenable=yes\njbmaxsize=100\n")
    with open(os.path.join(d, "b.conf"), "w") as f:
        f.write("jbmaxsize=900\n" + "# filler line\n" * 5000)
    lines = TX.read_log_lines(spark, d, host="h1")
    kv = {r.key: r.value for r in TX.extract_kv(lines, TX.CONFIG_KEYS, order_col="line_key").collect()}
    assert kv == {"jbenable": "yes", "jbmaxsize": "100"}


def test_column_text_drops_header_and_footer(spark):
    rows = ["Channel              Location             State   Application(Data)",
            "SIP/100-0001  100@default  Up  Dial(SIP/x)", "", "SIP/200-0002  200@default  Ring  Dial(SIP/y)",
            "2 active channels", "1 active call"]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "line_no long, line string")
    got = [(r.channel, r.state) for r in TX.parse_columns(df).orderBy("line_no").collect()]
    assert got == [("SIP/100-0001", "Up"), ("SIP/200-0002", "Ring")]
    freq = {r.state: r["count"] for r in A.column_freq(TX.parse_columns(df), "state").collect()}
    assert freq == {"Up": 1, "Ring": 1}


def test_component_presence_zero_filled(spark):
    rows = spark.createDataFrame([(1, "h1", "perl AST_VDauto_dial.pl VDAD"), (2, "h2", "sshd")], "row_no long, host string, line string")
    got = {(r.host, r.component): (r.matches, r.status) for r in A.component_presence(rows).collect()}
    assert got[("h1", "vdad")] == (1, "PASS") and got[("h2", "vdad")] == (0, "FAIL")
    assert got[("h2", "fastagi")] == (0, "FAIL") and len(got) == 8
