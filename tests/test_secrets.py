"""Secret patterns and file names over source files."""

from quillspan.operators.secrets import secret_files, secret_lines


def test_secrets_are_told_by_line_and_name(spark):
    key = "AIza" + "x" * 35
    rows = [
        ("a.gs", f"// one\r\nconst k = '{key}', t = 'ya29.a-b';\nend"),
        ("conf/key.json", '{\n "private_key":  "-----BEGIN PRIVATE KEY-----"}'),
        ("short.gs", key[:-1] + "\nya29.\n"),
        ("node_modules/b.gs", key), ("c.PNG", key), ("bin.gs", key + "\0"), ("big.gs", "x\n" * 200_000 + key),
        (".env", "A=1"), ("app/.env.local", ""), (".tool/.clasprc.json", ""), (".git/.env", ""), (".env/readme", ""), ("x.env", ""), ("dist/.env", ""),
    ]
    df = spark.createDataFrame(rows, "file string, content string")
    want = [("a.gs", 2, "GOOGLE_API_KEY"), ("a.gs", 2, "OAUTH_ACCESS_TOKEN"), ("big.gs", 200_001, "GOOGLE_API_KEY"), ("conf/key.json", 2, "SERVICE_ACCOUNT_PRIVATE_KEY")]
    assert sorted(map(tuple, secret_lines(df).collect())) == want
    assert sorted(r.file for r in secret_files(df, look_into=[".tool"]).collect()) == [".env", ".tool/.clasprc.json", "app/.env.local"]
