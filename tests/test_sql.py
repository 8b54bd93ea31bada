from corvane.plans.sql import register


def test_functions_by_name(spark):
    assert "lex_tokens" in register(spark)
    row = spark.sql(
        "SELECT ascii_lower('ABÉ') a, word_tokens('x y-1') b, court_level('某中级人民法院') c, lex_tokens('人民法院 判决') d, pdf_text(CAST('junk' AS BINARY)) e, "
        "cosine(embed('abc'), embed('abc')) f, cosine(array(1D), array(1D, 2D)) g"
    ).first()
    assert row.a == "abÉ" and row.b == ["x", "y", "1"] and row.c == "中级" and row.d[0] == "人民法院" and row.e == "" and abs(row.f - 1) < 1e-9 and row.g == 0
