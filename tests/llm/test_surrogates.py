import collections
import re

import pytest

from palimpsest.llm import surrogates as sg

KEY = b"k"
TEXT = ('Mr. John Smith (john.Smith@Mail.example.com, +1 (663) 555-6869) met Anna Smith. SMITH paid 4111 1111 1111 1111 and 4111111111111111 '
        'from 10.1.2.3; token = "1eb9c654e721b4f812088970e66a6345cee33dd6" GB82 WEST 1234 5698 7654 32, 078-05-1120; госпожа Ольга Иванова said hi to (663) 555-6869')


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d // 10 + d % 10
    return total % 10 == 0


def test_mentions_and_formats():
    found = [(k, TEXT[a:b]) for a, b, k, _ in sg.mentions(TEXT)]
    assert found == [("person", "John"), ("person", "Smith"), ("email", "john.Smith@Mail.example.com"), ("phone", "+1 (663) 555-6869"), ("person", "Anna"), ("person", "Smith"),
                     ("person", "SMITH"), ("card", "4111 1111 1111 1111"), ("card", "4111111111111111"), ("ip", "10.1.2.3"), ("secret", "1eb9c654e721b4f812088970e66a6345cee33dd6"),
                     ("iban", "GB82 WEST 1234 5698 7654 32"), ("ssn", "078-05-1120"), ("person", "Ольга"), ("person", "Иванова"), ("phone", "(663) 555-6869")]
    new, marks = sg.rewritten(TEXT, KEY, {})
    assert len(marks) == len(found)
    again = [(k, new[a:b]) for a, b, k, _ in sg.mentions(new)]
    parts = collections.defaultdict(list)
    for k, m in again:
        parts[k].append(m)
    shape = lambda t: re.sub("[a-z]", "a", re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t)))
    for kind in ("email", "phone", "card", "ssn", "iban"):
        old = [m for k, m in found if k == kind]
        assert [shape(m) for m in parts[kind]] == [shape(m) for m in old] and not set(old) & set(parts[kind])
    assert parts["phone"][0].endswith(parts["phone"][1]) and parts["phone"][0].startswith("+1 ")
    assert parts["card"][0].replace(" ", "") == parts["card"][1] and luhn(parts["card"][1]) and parts["card"][1][0] == "4"
    assert parts["email"][0].endswith(".com") and re.fullmatch("[0-9a-f]{40}", parts["secret"][0])
    names = re.fullmatch(r"Mr\. (\w+) (\w+) \(.*\) met (\w+) (\w+)\. (\w+) paid.*госпожа (\w+) (\w+) said.*", new)
    he, smith, she, smith2, loud, olga, ivanova = names.groups()
    assert smith == smith2 and loud == smith.upper() and smith != "Smith"
    assert not he.endswith("a") and she.endswith("a") and olga.endswith("а") and ivanova.endswith("ова")
    assert re.fullmatch("[А-я]+", olga + ivanova) and re.fullmatch("[A-z]+", he + she + smith)


def test_left_alone():
    clean = ["", "4785380592391138 and 1234567890123456", "999.1.2.3 v1.2.3.4.5", "a@b", "the miss Of it", "john said, Summer 2020-01-02 12:30", "x" * 100_000 + "@" * 1000, "mr", "Dr", "Anna"]
    for t in clean:
        assert sg.rewritten(t, KEY, {}) == (t, [])


def test_other_scripts_and_cases():
    new, _ = sg.rewritten("Herr MÜLLER, Mr Կարեն Պետրոսյան", KEY, {})
    words = sg.WORD.findall(new)
    assert words[0] == "Herr" and words[1].isupper() and sg.script_of(words[3]) == "armenian" and words[3] != "Կարեն"
    assert sg.rewritten("JOHN.SMITH@X.ORG", KEY, {})[0].isupper()


def brute(rows, key):
    """One entity after the other, over plain lists."""
    uses = collections.defaultdict(collections.Counter)
    for *_, t in rows:
        for e, u in {(e, m[4] if m[2] == "person" else None) for m in sg.used_mentions(t) for e in sg.entities_of(m[2], m[3])}:
            uses[e][u] += 1
    every = sorted(uses)
    use = {e: max(c, key=lambda u: (c[u], {"family": 2, "f": 1}.get(u, 0))) for e, c in uses.items()}
    attempt = dict.fromkeys(every, 0)
    while True:
        made = {e: sg.surrogate(key, *e, attempt[e], use[e]) for e in every}
        groups = collections.defaultdict(list)
        for e in every:
            groups[e[0], made[e]].append((attempt[e], e[1]))
        lost = {e for e in every if (e[0], made[e]) in attempt or min(groups[e[0], made[e]]) != (attempt[e], e[1])}
        if not lost:
            known = {e: (attempt[e], use[e]) for e in every}
            return attempt, made, [(*r[:-1], *((None, []) if r[-1] is None else sg.rewritten(r[-1], key, known))) for r in rows]
        for e in lost:
            attempt[e] += 1


@pytest.mark.parametrize("most_sent", [100_000, 0])
def test_whole_query_by_definition(spark, docs_of, most_sent):
    # All addresses 1-9.1-9.1-9.x of one digit: many collisions; a hot address in a third of the rows.
    rows = [(i, f"from {1 + i % 9}.{1 + i // 9 % 9}.1.{1 + i // 81 % 9} to {'5.5.5.5' if i % 3 == 0 else 'nobody'} a{i % 7}@b.org") for i in range(900)]
    rows += [(5, rows[5][1]), (5, rows[5][1]), (None, "ask Frau Anna Weiß or Weiß"), (2000, None), (2001, ""), (2002, TEXT), (2003, ("word " * 50_000 + TEXT + " ") * 2)]
    attempt, made, want = brute(rows, KEY)
    assert max(attempt.values()) > 1 and len({(k, made[k, v]) for k, v in made}) == len(made) and not {(k, made[k, v]) for k, v in made} & set(made)
    docs = docs_of([(*r, "x", 1) for r in rows], ", surrogate_text string, mentions int")
    got = sg.pseudonymised(docs, KEY, most_sent=most_sent).collect()
    plain = lambda rows: sorted(((i, t, [tuple(m.values()) if isinstance(m, dict) else tuple(m) for m in ms]) for i, t, ms in rows), key=repr)
    assert plain(got) == plain(want)


def test_fewer_values_than_entities():
    # Two-letter domains below one top-level domain: more entities than a format has values is still distinct.
    taken = set()
    for value in [f"{a}{b}.de" for a in "abcdefghijklmnopqrstuvwxyz" for b in "abcdefghijklmnopqrstuvwxyz"]:
        n = 0
        while (m := sg.surrogate(KEY, "domain", value, n)) in taken or re.fullmatch("[a-z]{2}\\.de", m):
            n += 1
            assert n < 200
        taken.add(m)
    for kind, value in [("ip", "1.1.1.1"), ("phone", "1|2"), ("ssn", "078051120"), ("iban", "GB82WEST12345698765432"), ("card", "4111111111111111"), ("secret", "aaaaaaaa"), ("ip6", "2001:0db8:0000:0000:0000:0000:0000:0001"), ("person", "latin:smith")]:
        if kind:
            assert len({sg.surrogate(KEY, kind, value, n) for n in range(40)}) > 20


def test_key_and_empty_table(spark, docs_of):
    assert sg.rewritten(TEXT, b"other", {})[0] != sg.rewritten(TEXT, KEY, {})[0] == sg.rewritten(TEXT, KEY, {})[0]
    assert sg.pseudonymised(docs_of([(1, TEXT)]).limit(0), KEY).collect() == []
    assert sg.pseudonymised(docs_of([(1, None)]), KEY).collect()[0].surrogate_text is None


def written(text, *, uses=None):
    return sg.rewritten(text, KEY, uses or {})[0]


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "GB82WEST12345698765432", "FR1420041010050500013M02606", "AT61 1904 3002 3457 3201"])
def test_ibans_stay_ibans_of_their_country(iban):
    """Read with no help of the module: country, shape place by place, and the check by the published rule."""
    new = written(f"pay {iban} now")[4:-4]
    shape = lambda t: re.sub("[A-Z]", "A", re.sub("[0-9]", "9", t))
    assert new != iban and new[:2] == iban[:2] and shape(new) == shape(iban)
    bare = new.replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


@pytest.mark.parametrize("phone, code", [("+353 1 234 5678", "+353 "), ("+420 601 234 567", "+420 "), ("+49 171 2345678", "+49 "), ("+1 (663) 555-6869", "+1 ("), ("+7 495 1234567", "+7 "), ("+971 50 123 4567", "+971 "), ("0171 2345678", "0")])
def test_country_codes_stay(phone, code):
    new = written(f"call {phone}.")[5:-1]
    assert new != phone and new.startswith(code) and re.sub("[0-9]", "9", new) == re.sub("[0-9]", "9", phone)


def test_digits_stay_digits():
    assert re.fullmatch("token=[0-9]{20}", written("token=12345678901234567890")) and re.fullmatch("[0-9]{18}@[a-z]+.org", written("123456789012345678@mail.org"))
    assert re.fullmatch("password=[a-z]{6}[0-9]", written("password=hunter2")) and written("password=hunter2") != "password=hunter2"


def test_more_formats_and_introductions():
    new = written("from 2001:db8::8a2e:370:7334 at 12:30:45, std::vector a::b")
    assert re.fullmatch(r"from [0-9a-f:]+ at 12:30:45, std::vector a::b", new) and "370:7334" not in new
    assert "Emily" not in (new := written("Dear Emily, thanks. Regards,\nJacob Miller")) and "Miller" not in new and re.fullmatch(r"Dear [A-Z][a-z]+, thanks\. Regards,\n[A-Z][a-z]+ [A-Z][a-z]+", new)
    assert written("My name is Priya Raman. Raman said so")[11:] != "Priya Raman. Raman said so"
    assert written("Dear all, hello world. Best regards") == "Dear all, hello world. Best regards"


def test_one_name_has_one_surrogate_in_every_setting(docs_of):
    rows = [(1, "Mr Andrea Rossi came"), (2, "Dr Andrea Rossi left"), (3, "Mrs Andrea Bianchi and Mr Rossi"), (4, "Mr Andrea Verdi"), (5, "ANDREA? Dr Andrea Rossi")]
    texts = {r.doc_id: r.surrogate_text for r in sg.pseudonymised(docs_of(rows), KEY).collect()}
    andrea, rossi = texts[1].split()[1:3]
    assert texts[2] == f"Dr {andrea} {rossi} left" and texts[3].startswith(f"Mrs {andrea} ") and texts[3].endswith(f" and Mr {rossi}") and texts[4].startswith(f"Mr {andrea} ")
    assert texts[5] == f"{andrea.upper()}? Dr {andrea} {rossi}"


def test_written_names_are_distinct_and_no_originals(spark, docs_of):
    """Thousands of names as given and family names: the map from written name to written name is one to one."""
    import itertools

    names = ["".join(x).capitalize() for x in itertools.product("bdfgklmnprst", "aeiou", "bdfgklmnprst", "aeiou")]
    rows = [(i, f"Mr {a} {b} met Mrs {b} {c}") for i, (a, b, c) in enumerate(zip(names, names[7:], names[31:]))]
    done = {r.doc_id: r.surrogate_text for r in sg.pseudonymised(docs_of(rows), KEY).collect()}
    to = {}
    for i, text in rows:
        for old, new in zip(re.findall(r"[A-Z]\w+", text), re.findall(r"[A-Z]\w+", done[i]), strict=True):
            if old not in ("Mr", "Mrs"):
                assert to.setdefault(old.lower(), new.lower()) == new.lower()
    assert len(to) > 3000 and len(set(to.values())) == len(to) and not set(to) & set(to.values())
