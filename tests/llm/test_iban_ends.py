from tessel.llm.pii import find_pii

CASES = {
    "IBAN DE89370400440532013000 Please pay": ["DE89370400440532013000"],
    "iban DE89370400440532013000 12 May": ["DE89370400440532013000"],
    "IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF": ["DE89 3704 0044 0532 0130 00"],
    "IBAN GB82 WEST 1234 5698 7654 32 FR14 2004 1010 0505 0001 3M02 606 NOW": ["GB82 WEST 1234 5698 7654 32", "FR14 2004 1010 0505 0001 3M02 606"],
    "account NO9386011117947 A MT84MALT011000012345MTLCAST001S 7": ["NO9386011117947", "MT84MALT011000012345MTLCAST001S"],
    "iban AB12 DE89 3704 0044 0532 0130 00 OK": ["DE89 3704 0044 0532 0130 00"],
    "iban DE89370400440532013000Z DE88370400440532013000 A": [],
}


def test_ibans_before_capitals_and_numbers(spark):
    texts = list(CASES)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {texts[r["doc_id"]]: [texts[r["doc_id"]][s["start"] : s["end"]] for s in r["spans"] if s["kind"] == "iban"] for r in find_pii(rows).collect()}
    assert got == CASES
