"""Rules over hand-annotated sentences: word/lemma/pos/dep/head."""

import pytest

from tracewell.operators import extraction

SCHEMA = "doc_id string, sent int, i int, text string, lemma string, pos string, dep string, head int"
CASES = {
    "active with conjunct": (
        "Attackers/attacker/NOUN/nsubj/1 steal/steal/VERB/ROOT/1 data/data/NOUN/dobj/1 and/and/CCONJ/cc/2 keys/key/NOUN/conj/2",
        [("Attackers", "steal", "data", 1), ("Attackers", "steal", "keys", 1)]),
    "passive with agent": (
        "Files/file/NOUN/nsubjpass/2 were/be/AUX/auxpass/2 encrypted/encrypt/VERB/ROOT/2 by/by/ADP/agent/2 malware/malware/NOUN/pobj/3",
        [("malware", "encrypt", "Files", 2)]),
    "passive without agent": ("Files/file/NOUN/nsubjpass/2 were/be/AUX/auxpass/2 deleted/delete/VERB/ROOT/2", [("ANY", "delete", "Files", 2)]),
    "means": (
        "Actors/actor/NOUN/nsubj/1 gain/gain/VERB/ROOT/1 access/access/NOUN/dobj/1 via/via/ADP/prep/1 phishing/phishing/NOUN/compound/5 emails/email/NOUN/pobj/3",
        [("Actors", "gain", "access", 1), ("Actors", "use", "phishing emails", 2)]),
    "gerund after before": (
        "He/he/PRON/nsubj/1 runs/run/VERB/ROOT/1 code/code/NOUN/dobj/1 before/before/ADP/prep/1 wiping/wipe/VERB/pcomp/3 disks/disk/NOUN/dobj/4",
        [("He", "run", "code", 1), ("He", "wipe", "disks", 5)]),
    "complement of a command": (
        "It/it/PRON/nsubj/1 forces/force/VERB/ROOT/1 users/user/NOUN/dobj/1 to/to/PART/aux/4 open/open/VERB/xcomp/1 links/link/NOUN/dobj/4",
        [("It", "force", "users", 1), ("users", "open", "links", 4)]),
    "subject of a second verb": (
        "It/it/PRON/nsubj/1 reads/read/VERB/ROOT/1 logs/log/NOUN/dobj/1 and/and/CCONJ/cc/1 sends/send/VERB/conj/1 mail/mail/NOUN/dobj/4",
        [("It", "read", "logs", 1), ("It", "send", "mail", 4)]),
    "from and to": (
        "They/they/PRON/nsubj/1 copy/copy/VERB/ROOT/1 files/file/NOUN/dobj/1 from/from/ADP/prep/1 hosts/host/NOUN/pobj/3",
        [("They", "copy", "files", 1), ("files", "from", "hosts", 3)]),
    "participle": ("Tools/tool/NOUN/ROOT/0 written/write/VERB/acl/0", [("ANY", "write", "Tools", 1)]),
    "naming": ("malware/malware/NOUN/ROOT/0 named/name/VERB/acl/0 Foo/foo/PROPN/oprd/1", [("malware", "name", "Foo", 1)]),
    "possessive": ("victim/victim/NOUN/poss/2 's/'s/PART/case/0 computer/computer/NOUN/ROOT/2", [("computer", "of", "victim", 2)]),
    "based": ("cloud-based/cloud-based/VERB/amod/1 service/service/NOUN/ROOT/1", [("cloud-based service", "basedon", "cloud", 0)]),
    "nominal": ("data/data/NOUN/compound/1 collection/collection/NOUN/ROOT/1", [("ANY", "collect", "data", 1)]),
    "examples": ("tools/tool/NOUN/ROOT/0 such/such/ADJ/amod/2 as/as/ADP/prep/0 Nmap/nmap/PROPN/pobj/2", [("tools", "as", "Nmap", 2)]),
    "as": ("It/it/PRON/nsubj/1 runs/run/VERB/ROOT/1 code/code/NOUN/dobj/1 as/as/ADP/prep/1 root/root/NOUN/pobj/3", [("It", "run", "code", 1), ("code", "as", "root", 3)]),
    "done for": (
        "He/he/PRON/nsubj/1 gets/get/VERB/ROOT/1 files/file/NOUN/nsubj/3 sent/send/VERB/ccomp/1", [("ANY", "send", "files", 3)]),
    "relative": (
        "tool/tool/NOUN/ROOT/0 which/which/PRON/nsubj/2 steals/steal/VERB/relcl/0 data/data/NOUN/dobj/2", [("tool", "steal", "data", 2)]),
    "no verb": ("data/data/NOUN/ROOT/0", []),
}


def tokens(spark, texts):
    rows = [(d, 0, i, *w.rsplit("/", 4)[:4], int(w.rsplit("/", 4)[4])) for d, t in texts.items() for i, w in enumerate(t.split())]
    return extraction.sentences(spark.createDataFrame(rows, SCHEMA), "doc_id", "sent")


@pytest.fixture(scope="module")
def found(spark):
    rows = extraction.events(tokens(spark, {k: v[0] for k, v in CASES.items()}), "doc_id", "sent").collect()
    return {k: sorted((r for r in rows if r.doc_id == k), key=lambda r: r.seq) for k in CASES}


@pytest.mark.parametrize("case", CASES)
def test_rule(found, case):
    assert [(r["sub"], r.verb, r.obj, r.verb_index) for r in found[case]] == CASES[case][1]


def test_flags(found):
    assert [r.flag for r in found["examples"]] == [1] and [r.flag for r in found["naming"]] == [1] and [r.flag for r in found["as"]] == [0, 0]
    assert [r.sub_id for r in found["passive without agent"]] == [0]


def test_negation_and_nulls(spark):
    t = "Files/file/NOUN/nsubjpass/3 were/be/AUX/auxpass/3 not/not/PART/neg/3 deleted/delete/VERB/ROOT/3"
    assert [r.negated for r in extraction.events(tokens(spark, {"a": t}), "doc_id", "sent").collect()] == [True]
    empty = spark.createDataFrame([("a", 0, 0, None, None, None, None, None)], SCHEMA)
    assert extraction.events(extraction.sentences(empty, "doc_id", "sent"), "doc_id", "sent").collect() == []


def test_sentence_without_subject(spark):
    texts = {"a": "Uses/use/VERB/ROOT/0 tools/tool/NOUN/dobj/0", "b": "It/it/PRON/nsubj/1 runs/run/VERB/ROOT/1"}
    got = {r.doc_id: r.text for r in extraction.without_subject(tokens(spark, texts), "doc_id", "sent").collect()}
    assert got == {"a": "Attacker can use tools", "b": "It runs"}


def test_labels(spark):
    events = extraction.events(tokens(spark, {"a": CASES["means"][0], "b": CASES["possessive"][0]}), "doc_id", "sent")
    labels = spark.createDataFrame([("a", 0, "access", "DATA"), ("a", 0, "access", "OTHER"), ("b", 0, "victim", "OTHER")], "doc_id string, sent int, phrase string, label string")
    got = [(r["sub"], r.obj, r.sub_label, r.obj_label) for r in extraction.label_events(events, labels, "doc_id", "sent").collect()]
    assert got == [("Actors", "access", ["OTHER"], ["DATA"])]
