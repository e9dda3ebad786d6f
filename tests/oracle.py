"""The semantics in plain Python, record after record, for tests to compare plans with."""

import hashlib
import re

WEIGHT = {"ats": 0.95, "recruiter_notes": 0.75}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()


def phone(raw):
    s = (raw or "").strip()
    d = re.sub("[^0-9]", "", s)
    if not 7 <= len(d) <= 15:
        return None
    if s[:1] == "+":
        return "+" + d
    return "+1" + d if len(d) == 10 else "+" + d if len(d) == 11 and d[0] == "1" else None


def date(raw):
    s = (raw or "").strip()
    if s.lower() in ("present", "current", "now", "ongoing", "till date", "to date"):
        return "Present"
    full = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
    name = lambda m: full.index(m) + 1 if m in full else MONTHS.index(m) + 1 if m in MONTHS else 9 if m == "sept" else None
    if m := re.fullmatch(r"(\d{4})[/\-.](\d{1,2})([/\-.]\d{1,2})?", s):
        year, month = m[1], int(m[2])
    elif m := re.fullmatch(r"([A-Za-z]+)\.?\s+(\d{4})", s):
        year, month = m[2], name(m[1].lower())
    elif m := re.fullmatch(r"(\d{4})\s+([A-Za-z]+)\.?", s):
        year, month = m[1], name(m[2].lower())
    elif re.fullmatch(r"\d{4}", s):
        year, month = s, 1
    else:
        return None
    return f"{year}-{month:02d}" if month and 1 <= month <= 12 and 1900 <= int(year) <= 2100 else None


def keys(p):
    out = {("email", e.strip().lower()) for e in p["emails"] if e and e.strip()}
    return out | {("phone", phone(x)) for x in p["phones"] if phone(x)}


def greedy(profiles):
    """Clusters as lists of records, by one pass."""
    clusters = []
    for p in profiles:
        mine = keys(p)
        for c in clusters:
            if c["keys"] & mine:
                break
        else:
            clusters.append(c := {"keys": set(), "rows": []})
        c["keys"] |= mine
        c["rows"].append(p)
    return [c["rows"] for c in clusters]


def clean(s):
    return (s or "").strip() or None


def merge(rows, country):
    """The canonical record of one cluster; ``country`` normalises a country or gives None."""
    weight = lambda p: WEIGHT.get(p["_source_type"], 0.7)
    rows = sorted(rows, key=lambda p: (-weight(p), p["ordinal"]))
    log, name = [], None
    emails, phones, skills, jobs, schools = {}, {}, {}, {}, {}
    place = links = None
    for p in rows:
        source = p["_source_type"] or "unknown"
        say = lambda field, method, value: log.append((field, source, method, value))

        def resolve(field, now, new):
            if not new:
                return now
            if not now:
                say(field, "initial_write", new)
                return new
            if now.lower() != new.lower():
                say(field, "confidence_held", now)
            return now

        name = resolve("full_name", name, clean(p["full_name"]))
        for kind, held, key in (("emails", emails, lambda e: (e or "").strip().lower()), ("phones", phones, phone)):
            for raw in p[kind]:
                if key(raw) and key(raw) not in held:
                    held[key(raw)] = raw
                    say(kind, "array_union", raw)
        for raw in p["skills"]:
            if not (s := clean(raw)):
                continue
            if s.lower() not in skills:
                skills[s.lower()] = [s, weight(p), [source]]
                say(f"skills[{s}]", "initial_write", s)
            elif source not in skills[s.lower()][2]:
                skills[s.lower()][2].append(source)
                say(f"skills[{skills[s.lower()][0]}]", "skill_source_added", skills[s.lower()][0])
        new = []
        for x in p["experience"]:
            c, t = clean(x["company"]), clean(x["title"])
            if c and t:
                start, end = clean(x["start"]), clean(x["end"])
                new.append((c, t, (start and (date(start) or start)) or "", end and (date(end) or end), clean(x["summary"])))
                say(f"experience[{c}|{t}]", "initial_write", f"{c} / {t} ({new[-1][2]} → {new[-1][3] or 'Present'})")
        for x in new:
            if (k := (x[0].lower(), x[1].lower())) in jobs:
                say(f"experience[{x[0]}|{x[1]}]", "duplicate_confirmed", f"{x[0]} / {x[1]}")
            else:
                jobs[k] = x
        new = []
        for x in p["education"]:
            if i := clean(x["institution"]):
                dated = lambda v: clean(v) and (date(v) or clean(v))
                new.append((i, clean(x["degree"]), clean(x["field_of_study"]), dated(x["start"]), dated(x["end"])))
                say(f"education[{i}]", "initial_write", i)
        for x in new:
            if x[0].lower() in schools:
                say(f"education[{x[0]}]", "duplicate_confirmed", x[0])
            else:
                schools[x[0].lower()] = x
        raw = p["location"] or {}
        got = {"city": clean(raw.get("city")), "region": clean(raw.get("region"))}
        got["country"] = clean(raw.get("country")) and (country(raw["country"]) or clean(raw["country"]))
        if any(got.values()):
            if place is None:
                for k, v in got.items():
                    if v:
                        say(f"location.{k}", "initial_write", v)
                place = got | {"country": got["country"] and got["country"].upper()}
            else:
                got["country"] = got["country"] and got["country"].upper()
                place = {k: resolve(f"location.{k}", place[k], got[k]) for k in got}
        raw = p["links"] or {}
        got = {k: clean(raw.get(k)) for k in ("linkedin", "github", "portfolio")}
        other = [x.strip() for x in raw.get("other") or [] if x and x.strip()]
        if any(got.values()) or other:
            if links is None:
                for k, v in got.items():
                    if v:
                        say(f"links.{k}", "initial_write", v)
                links = got | {"other": other}
            else:
                links = {k: resolve(f"links.{k}", links[k], got[k]) for k in got} | {"other": list(dict.fromkeys(links["other"] + other))}
    ids = sorted({*emails, *phones})
    return {
        "candidate_id": "cand-" + hashlib.sha256("|".join(ids).encode()).hexdigest()[:12] if ids else None,
        "full_name": name,
        "emails": list(emails),
        "phones": list(phones),
        "location": place and tuple(place.values()),
        "links": links and (links["linkedin"], links["github"], links["portfolio"], links["other"]),
        "skills": [tuple(s) for s in skills.values()],
        "experience": list(jobs.values()),
        "education": list(schools.values()),
        "overall_confidence": round(max(weight(p) for p in rows), 4),
        "provenance": log,
        "raw_sources": list(dict.fromkeys(p["_source_id"] for p in rows)),
    }
