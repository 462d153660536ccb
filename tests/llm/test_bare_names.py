"""Names that stand alone or in capitals, and addresses that the first look must not pass over."""

import re

from saltmarsh.llm import pii

SHORT = "doc_id long, text string"


def test_names_alone_and_in_capitals_agree_with_the_full_name(spark):
    texts = ["Mary Smith wrote. Smith then left; SMITH and Mary came back, a blacksmith and Smithers too.", "Mr. JAMES SMITH and JAMES SMITH met James Smith."]
    got = {r["doc_id"]: r["text"] for r in pii.surrogates(spark.createDataFrame(list(enumerate(texts)), SHORT), b"key").collect()}
    given, surname, later, capitals, given_later = re.match(r"(\w+) (\w+) wrote. (\w+) then left; (\w+) and (\w+) came back, a blacksmith and Smithers too.$", got[0]).groups()
    assert surname == later == capitals.title() and given == given_later and surname != "Smith" and given != "Mary"
    assert not re.search("james|smith", got[1], re.I)
    full = re.match(r"Mr. (\w+ \w+) and (\w+ \w+) met (\w+ \w+).$", got[1]).groups()
    assert full[0] == full[1] == full[2].upper() and full[2].endswith(surname)


def test_every_address_passes_the_first_look(spark):
    texts = [f"jane{c}@example.com" for c in "_-+.%"]
    assert all(pii.mentions(t) for t in texts)
    got = pii.surrogates(spark.createDataFrame(list(enumerate(texts)), SHORT), b"key").collect()
    assert len(got) == 5 and all(r["n_entities"] == 1 and "jane" not in r["text"] for r in got)
