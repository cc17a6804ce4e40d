"""Résumés: the state machine and the merge against plain loops, and tables to fill."""

from __future__ import annotations

import random
import re

from corpuskiln.operators import resumes
from corpuskiln.operators.resumes import KOREAN

HEADS = ["기간 | 학교명 | 학 위", "구분 | 직장명 | 담당업무", "일자 | 자격증명 | 발급기관", "강의주제 | 일자", "프로젝트명 | 발주처", "2020.01 | 학교명 | 학위"]
CELLS = ["학력", "경력", "자격", "성 명", "소속", "이메일", "e-Mail", "홍길동", "2020.01", "2021-03", "A사", "투자 과정 이수", "수료", "사진", "", " ", "　", "석사 수료", "석사", "박사", "B대", "C"]


def norm(x):
    return re.sub(r"\s+", "", x).lower()


def plain_parse(lines):
    """(pos, part, what, kind, values), by a loop with a state."""
    out, section = [], None
    labels = {norm(k): v for k, v in KOREAN.identity.items()}
    for pos, line in enumerate(lines):
        line = (line or "").strip()
        if line and "|" not in line:
            if re.search("[『「].+[』」]", line):
                out.append((pos, 0, "publications", "publications", [line]))
            continue
        cells = [c.strip() for c in line.split("|")] if line else []
        while cells and norm(cells[-1]) in KOREAN.drop:
            cells.pop()
        if not cells:
            continue
        dated = re.match(r"\s*\d{4}[.\-]", cells[0])
        joined = "".join(map(norm, cells))
        head = next((s for s in KOREAN.sections if not dated and any(all(w in joined for w in ws) for ws in s.signatures)), None)
        if head:
            section = head
            continue
        body = None
        if section and section.tag is None:
            body = cells if dated else None
        elif section and norm(cells[0]) not in labels:
            body = cells[1:] if norm(cells[0]) == section.tag else cells if dated else None
        if body is not None:
            values = [(body[i] if i < len(body) else "") or None for i in range(len(section.fields))]
            if section.tag is None or values[0] or values[1]:
                name = norm(values[1] or "")
                trained = section.kind == "certs" and (name.endswith(("수료", "이수")) or "과정이수" in name)
                out.append((pos, 0, "record", "trainings" if trained else section.kind, values))
            continue
        if len(cells) < 2:
            continue
        pairs = [(cells[0], cells[1])] + ([(cells[2], cells[3])] if len(cells) >= 4 else [])
        found = [(labels[norm(a)], b) for a, b in pairs if norm(a) in labels and norm(b) not in KOREAN.drop]
        out += [(pos, i, "identity", k, [v]) for i, (k, v) in enumerate(found)]
    return out


def random_lines(rng):
    return [rng.choice([rng.choice(HEADS), " | ".join(rng.choices(CELLS, k=rng.randint(1, 6))), "저서 『가나다』", "", None, "글"]) for _ in range(rng.randint(0, 25))]


def test_state_machine_equals_a_loop(spark):
    rng = random.Random(1)
    docs = {i: random_lines(rng) for i in range(250)}
    rows = spark.createDataFrame([(i, p, x) for i, xs in docs.items() for p, x in enumerate(xs)], "doc_id int, pos int, line string")
    found = {}
    for r in resumes.parse(rows).orderBy("doc_id", "pos", "part").collect():
        found.setdefault(r.doc_id, []).append((r.pos, r.part, r.what, r.kind, r["values"]))
    kinds = set()
    for i, xs in docs.items():
        expected = plain_parse(xs)
        assert found.get(i, []) == expected, xs
        kinds |= {x[3] for x in expected}
    assert set(KOREAN.kinds) <= kinds


def plain_merge(sources):
    """The merged profile of sources [(name, parsed rows)] in order."""
    identity, conflicts, lists, seen, replaced = {}, [], {k: [] for k in KOREAN.kinds}, set(), []
    keys = {"education": lambda v: tuple(v), "career": lambda v: tuple(v[:2]), "lectures": lambda v: tuple(v[:3]), "projects": lambda v: (v[0], v[1], v[3])}
    cert = lambda v: (v[1], v[2]) if v[2] else (v[1], v[0], v[3])
    for name, rows in sources:
        own = {}
        for _, _, what, kind, values in rows:
            if what == "identity":
                own.setdefault(kind, values[0])
            else:
                key = (kind, keys.get(kind, cert)(values) if what == "record" else values[0])
                if key not in seen:
                    seen.add(key)
                    lists[kind].append(values)
        for k, v in own.items():
            if identity.setdefault(k, v) != v and (k, v) not in {(c[0], c[2]) for c in conflicts}:
                conflicts.append((k, identity[k], v, name))
    studies, order = {}, []
    rank = lambda d: next((n for w, n in (("졸업", 3), ("졸", 3), ("수료", 2), ("휴학", 1), ("재학", 1), ("중퇴", 0)) if w in d.replace(" ", "")), 3)
    for n, v in enumerate(lists["education"]):
        level = next((x for x in ("박사", "석사", "학사") if x in (v[3] or "")), None)
        key = (v[1], v[2], level) if level and (v[1] or v[2]) else n
        if key not in studies:
            studies[key] = v
            order.append(key)
        elif rank(v[3]) > rank(studies[key][3]):
            replaced.append(studies[key])
            studies[key] = v
        else:
            replaced.append(v)
    lists["education"] = [studies[k] for k in order]
    return identity, conflicts, lists, replaced, [k for k in KOREAN.required if k not in identity]


def test_merge_equals_a_loop(spark):
    rng = random.Random(2)
    study = lambda: f"{rng.choice(['2019.01', '2020.02', '2021.03'])} | {rng.choice(['B대', 'C대', ''])} | {rng.choice(['공학', ''])} | {rng.choice(['석사 수료', '석사', '석사 재학', '박사', '박사 졸업', '기타', ''])}"
    people = {p: [random_lines(rng) + [HEADS[0]] + [study() for _ in range(rng.randint(0, 4))] for _ in range(rng.randint(1, 4))] for p in range(60)}
    rows = [(p, s, pos, x) for p, sources in people.items() for s, xs in enumerate(sources) for pos, x in enumerate(xs)]
    df = spark.createDataFrame(rows, "person int, priority int, pos int, line string")
    parsed = resumes.parse(df, keys=("person", "priority")).selectExpr("*", "concat('s', priority) AS source")
    found = {r.person: r for r in resumes.merge(parsed, "person", "source", "priority").collect()}
    n_replaced = n_conflicts = 0
    for p, sources in people.items():
        parts = [(f"s{s}", plain_parse(xs)) for s, xs in enumerate(sources)]
        if not any(x for _, x in parts):
            assert p not in found
            continue
        identity, conflicts, lists, replaced, missing = plain_merge(parts)
        r = found[p]
        assert r.identity == identity and r.missing == missing
        assert sorted(tuple(c) for c in r.conflicts) == sorted(conflicts)
        for k in KOREAN.kinds[:-1]:
            assert r[k] == lists[k], (p, k)
        assert r.publications == [v[0] for v in lists["publications"]]
        assert sorted(map(repr, r.replaced)) == sorted(map(repr, replaced))
        n_replaced, n_conflicts = n_replaced + len(replaced), n_conflicts + len(conflicts)
    assert n_replaced > 5 and n_conflicts > 5


def test_blank_rows_take_records_by_rank(spark):
    grid = [["이력", "", ""], ["기간", "학교명", "학위"], ["", "　", ""], ["2020", "", ""], ["", "", ""], ["\t", None, ""], ["기간", "학교명", "학위"]]
    cells = spark.createDataFrame([(1, 0, r, c, x) for r, xs in enumerate(grid) for c, x in enumerate(xs)] + [(2, 0, 0, 0, "학교명"), (3, 0, 0, 0, "기간"), (3, 0, 0, 1, "학교명 학위")], "doc_id int, `table` int, `row` int, col int, cell string")
    labels = {"education": {"기간": "period", "학교명": "school", "학위": "degree"}}
    columns, blank = resumes.map_tables(cells, KOREAN, labels)
    assert sorted((r.doc_id, r.col, r.field) for r in columns.collect()) == [(1, 0, "period"), (1, 1, "school"), (1, 2, "degree"), (3, 0, "period")]
    assert sorted((r.row, r.nth) for r in blank.collect()) == [(2, 1), (4, 2), (5, 3)]
    records = spark.createDataFrame([(1, "education", 1, ["2001", "A", None, "석사"]), (1, "education", 2, ["2002", "B", "x", None]), (1, "career", 1, ["a", "b", "c", "d"]), (3, "education", 1, ["z"] * 4)], "doc_id int, kind string, nth int, `values` array<string>")
    fills, report = resumes.fill_tables(cells, records, KOREAN, labels)
    assert sorted((r.row, r.col, r.value) for r in fills.collect()) == [(2, 0, "2001"), (2, 1, "A"), (2, 2, "석사"), (4, 0, "2002"), (4, 1, "B")]
    assert sorted(tuple(r) for r in report.collect()) == [(1, 0, "education", 2, 3, 2, 0), (3, 0, "education", 1, 0, 0, 1)]
    assert resumes.fill_tables(cells.limit(0), records, KOREAN, labels)[0].count() == 0
