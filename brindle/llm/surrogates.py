"""Surrogates for personal data (operator 7), DataFrame functions only.

Detected: e-mail addresses, IPv4 addresses, phone numbers with a country code, card-like numbers of 13 to 19 digits, hex secrets of 32 to
64 digits, names after a title, and every later or earlier bare mention, in the same document and letter case, of a word of such a name. Each entity has one or two components (a name: given name and surname), each of a kind, in a
canonical form that ignores case and punctuation. A component's surrogate depends on the key, the kind and the canonical
form alone, so one entity has one surrogate in all documents. It keeps the format: digits stay digits in the same places, a card
number keeps its Luhn validity, letters keep case, a given name keeps the gender that title or name list tells, names keep their script.

Digits are permuted by a Feistel network whose rounds are SHA-2 of key and half, so they can't collide. Other kinds are drawn from a keyed hash and checked: all
distinct components are grouped by surrogate, and of those that share one, or that equal a real component, all but the first are
drawn again until none is left. The check works on a table of distinct components; the mapping comes back by a join in which
the hottest components are broadcast. Only what is found of documents is shuffled: texts stay out of it, but for the documents with entities once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.llm._util import join_hot, stored, text_of, unused

_FEMALE, _MALE, _NEUTRAL = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora"), ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor"), ("Dr", "Prof", "Доктор")
GIVEN = {
    "f": "anna maria julia sofia clara elena laura emma nora alice eva marta lucia irene helen ruth".split(),
    "m": "john peter paul martin thomas david simon felix oscar hugo leon marco victor anton robert george".split(),
}
_LISTS = {
    "given:f:latin": "alba brenda cora dora edith flora greta hilda ines jana karla lena mona nina olga petra".split(),
    "given:m:latin": "adam boris carl dirk emil frank gustav henri ivan jonas kurt lars milo nils otto pablo".split(),
    "given:n:latin": "alex chris dana eden finn gale harper indy jules kim lee morgan noel perry robin sasha".split(),
    "given:f:cyrillic": "алла белла вера галина дарья елена жанна зоя инна кира лидия нина ольга полина рита тамара".split(),
    "given:m:cyrillic": "антон борис вадим глеб денис егор захар игорь кирилл лев марк олег павел роман семён тарас".split(),
    "given:n:cyrillic": "саша женя валя слава шура паша миша юра тоня коля лёня гоша витя костя толя федя".split(),
    "syllable:latin": "ba de fi go hu ka le mi no pu ra se ti vo wu za".split(),
    "syllable:cyrillic": "ба де фи го ху ка ле ми но пу ра се ти во ву за".split(),
    "syllable:greek": "βα δε φι γο χυ κα λε μι νο πυ ρα σε τι βο θυ ζα".split(),
    "syllable:han": list("安柏川丁恩方高何江林孟南秦苏唐文"),
}
#: Capital and letters, parts joined by apostrophe or hyphen; a possessive s is no part of the name.
_WORD = r"\p{Lu}[\p{L}]*+(?:['’-](?!s(?![\p{L}]))[\p{L}]++)*+"
_TITLE = "(?:" + "|".join((*_FEMALE, *_MALE, *_NEUTRAL)) + r")\.?+"
ENTITY = "|".join((
    r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+(?<=\.[A-Za-z]{2,12})",
    r"(?<![\d.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?\d)",
    r"\+\d{1,3}[ -]?\(?\d{2,4}\)?(?:[ -]?\d){5,8}(?!\d)",
    r"(?<![\d.])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)",
    r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,64}|[0-9A-F]{32,64})(?![0-9A-Za-z])",
    rf"(?<![\p{{L}}\d]){_TITLE} {_WORD}(?: {_WORD})?",
))


def _q(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _arr(words) -> str:
    return "array(" + ",".join(_q(w) for w in words) + ")"


def _kind(e: str) -> str:
    return f"case when contains({e},'@') then 'email' when startswith({e},'+') then 'phone' when {e} rlike '^\\\\d+[.]' then 'ip' when length({e})>=32 then 'secret' when {e} rlike '^[\\\\d -]+$' then 'card' else 'name' end"


def _script(w: str) -> str:
    return f"case when {w} rlike '\\\\p{{IsHan}}' then 'han' when {w} rlike '\\\\p{{IsCyrillic}}' then 'cyrillic' when {w} rlike '\\\\p{{IsGreek}}' then 'greek' else 'latin' end"


def _gender(e: str, given: str) -> str:
    return f"case when {e} rlike '^(?:{'|'.join(_FEMALE)})\\\\b' then 'f' when {e} rlike '^(?:{'|'.join(_MALE)})\\\\b' then 'm' when array_contains({_arr(GIVEN['f'])}, {given}) then 'f' when array_contains({_arr(GIVEN['m'])}, {given}) then 'm' else 'n' end"


def _parts(e: str) -> str:
    """SQL array of (k, c) of an entity: its components. A bare name has none here."""
    w = f"slice(split({e},' '),2,2)"
    surname = f"struct(concat('surname:',{_script(f'element_at({w},-1)')}) as k, lower(element_at({w},-1)) as c)"
    given = f"struct(concat('given:',{_gender(e, f'lower(element_at({w},1))')},':',{_script(f'element_at({w},1)')}) as k, lower(element_at({w},1)) as c)"
    digits = f"regexp_replace({e},'[^0-9]','')"
    return (
        f"case {_kind(e)} when 'name' then case size({w}) when 0 then filter(array(struct('' as k, '' as c)), z -> false) when 1 then array({surname}) else array({given},{surname}) end when 'email' then array(struct('email' as k, lower({e}) as c)) when 'phone' then array(struct('phone' as k, {digits} as c))"
        f" when 'card' then array(struct('card' as k, {digits} as c)) when 'ip' then array(struct('ip' as k, {e} as c)) else array(struct('secret' as k, lower({e}) as c)) end"
    )


def _feistel(left: str, right: str, m1: str, m2: str, salt: str) -> str:
    """SQL struct(l, r): a keyed permutation of pairs below (m1, m2). Runs once more than the attempt says."""
    m = f"if(i%2=1,{m1},{m2})"
    return f"aggregate(sequence(1,4+4*attempt), struct(cast({left} as bigint) as l, cast({right} as bigint) as r), (a,i)->struct(a.r as l, pmod(a.l+pmod(cast(conv(substring(sha2(concat_ws('|',{salt},i,a.r,{m1},{m2}),256),1,15),16,10) as bigint),{m}),{m}) as r))"


def _class_map(text: str, stream: str) -> str:
    """Each letter becomes a letter and each digit a digit, drawn from a hex stream of 128 digits."""
    v = f"cast(conv(substring({stream},1+2*pmod(p,64),2),16,10) as int)"
    return f"array_join(transform(split({text},''), (ch,p)->case when ch rlike '[a-z]' then chr(97+pmod({v}+p,26)) when ch rlike '[0-9]' then chr(48+pmod({v}+p,10)) else ch end),'')"


def _luhn(body: str) -> str:
    """SQL int: the check digit of a body of digits."""
    d = f"transform(reverse(split({body},'')), (ch,p)->if(p%2=0, cast(ch as int)*2-if(cast(ch as int)>4,9,0), cast(ch as int)))"
    return f"pmod(10-pmod(aggregate({d},0,(a,x)->a+x),10),10)"


def _digits(body: str, salt: str) -> str:
    n, h = f"length({body})", f"cast(length({body}) div 2 as int)"
    m1, m2 = f"cast(power(10,{h}) as bigint)", f"cast(power(10,{n}-{h}) as bigint)"
    f = _feistel(f"if({h}=0,'0',substring({body},1,{h}))", f"substring({body},{h}+1)", m1, m2, salt)
    return f"transform(array({f}), z->concat(if({h}=0,'',lpad(cast(z.l as string),{h},'0')), lpad(cast(z.r as string),{n}-{h},'0')))[0]"


def _surrogate(key: str) -> Column:
    """Surrogate of columns k, c, attempt."""
    salt = f"{_q(key)},k"
    s = f"sha2(concat_ws('|',{_q(key)},k,c,cast(attempt as string)),512)"
    local, domain = "substring_index(c,'@',1)", "substring_index(c,'@',-1)"
    tld = f"substring_index({domain},'.',-1)"
    host = f"substring({domain},1,length({domain})-length({tld})-1)"
    email = f"concat({_class_map(local, s)}, substring({s},1,attempt), '@', {_class_map(host, f'sha2(concat({_q(key)},{host}),512)')}, '.', {tld})"
    body, check = "substring(c,1,length(c)-1)", "cast(substring(c,-1) as int)"
    card = f"transform(array({_digits(body, salt)}), b->concat(b, cast(pmod({_luhn('b')}+{check}-{_luhn(body)},10) as string)))[0]"
    phone = f"concat(substring(c,1,1), {_digits('substring(c,2)', salt)})"
    o = "split(c,'[.]')"
    oct2 = lambda a, b: f"cast({o}[{a}] as int)*256+cast({o}[{b}] as int)"
    ip = f"transform(array({_feistel(oct2(0, 1), oct2(2, 3), '65536L', '65536L', salt)}), z->concat_ws('.',cast(z.l div 256 as string),cast(z.l%256 as string),cast(z.r div 256 as string),cast(z.r%256 as string)))[0]"
    pick = lambda words, p: f"{_arr(words)}[cast(conv(substring({s},{p},1),16,10) as int)]"
    syllables = lambda script: f"array_join(transform(sequence(1,if('{script}'='han',2,4)+attempt),q->{_arr(_LISTS[f'syllable:{script}'])}[cast(conv(substring({s},q+8,1),16,10) as int)]),'')"
    given = " ".join(f"when 'given:{g}:{sc}' then concat({pick(_LISTS[f'given:{g}:{sc}'], 1)}, if(c is null,'',{syllables(sc)}))" for g in "fmn" for sc in ("latin", "cyrillic"))
    surname = " ".join(f"when 'surname:{sc}' then {syllables(sc)}" for sc in ("latin", "cyrillic", "greek", "han"))
    other = " ".join(f"when 'given:{g}:{sc}' then {syllables(sc)}" for g in "fmn" for sc in ("greek", "han"))
    return F.expr(f"case k when 'email' then {email} when 'card' then {card} when 'phone' then {phone} when 'ip' then {ip} when 'secret' then substring({s},1,length(c)) {given} {other} {surname} end")


def mapping(components: DataFrame, key: str, most_rounds: int = 25) -> DataFrame:
    """(k, c, n, s) with one surrogate a distinct component (k, c), found n times; no two of a kind share one and none is a real component of its kind."""
    found = components.groupBy("k", "c").agg(F.count(F.lit(1)).alias("n")).withColumn("attempt", F.lit(0))
    rows = stored(found.withColumn("s", _surrogate(key)), "surrogates")
    for _ in range(most_rounds):
        shared = rows.groupBy("k", "s").agg(F.count(F.lit(1)).alias("n"), F.min("c").alias("keeps")).where("n > 1").select("k", "s", "keeps")
        real = rows.select("k", F.col("c").alias("s"))
        bad = rows.join(shared, ["k", "s"]).where("c <> keeps").select("k", "c").unionAll(rows.join(real, ["k", "s"], "left_semi").select("k", "c")).distinct()
        bad = stored(bad, "surrogate-clashes")
        if not bad.limit(1).count():
            return rows.select("k", "c", "n", "s")
        again = rows.join(bad, ["k", "c"], "left_semi").select("k", "c", "n", (F.col("attempt") + 1).alias("attempt")).withColumn("s", _surrogate(key))
        rows = stored(rows.join(bad, ["k", "c"], "left_anti").select("k", "c", "n", "attempt", "s").unionAll(again.select("k", "c", "n", "attempt", "s")), "surrogates")
    raise RuntimeError("surrogates did not settle")


def _render(e: str, s: str) -> str:
    """SQL string: entity e with the surrogates s of its components, in the format of e."""
    digits = f"aggregate(split({e},''), struct('' as o, 1 as p), (a,ch)->if(ch rlike '[0-9]', struct(concat(a.o,substring({s}[0],a.p,1)) as o, a.p+1 as p), struct(concat(a.o,ch) as o, a.p as p)), a->a.o)"
    w = f"split({e},' ')"
    cased = lambda at: f"transform({s}, (x,q)->if(length({w}[{at}])>1 and upper({w}[{at}])={w}[{at}], upper(x), concat(upper(substring(x,1,1)),substring(x,2))))"
    like = f"if(upper({e})={e}, upper({s}[0]), {s}[0])"
    return f"case {_kind(e)} when 'name' then if(size({w})=1, {cased('0')}[0], concat_ws(' ',{w}[0],array_join({cased('q+1')},' '))) when 'phone' then {digits} when 'card' then {digits} when 'ip' then {s}[0] else {like} end"


def replace_entities(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """docs with every detected entity of text_col replaced by its surrogate; adds _n_entities (long; a column of this name is replaced).
    All rows and other columns stay, whatever their names.

    Null text becomes the empty text with no entity. Every row is worked on by itself: null ids, repeated rows and repeated ids with
    other texts are kept, and equal entities have equal surrogates in all of them. An empty table gives an empty one.
    """
    row, names, pattern, e, rest, r, m = unused(docs, "_row", "_names", "_pattern", "_e", "_rest", "_r", "_m")
    text = text_of(text_col)
    any_of = lambda what: F.regexp_extract_all(text, what, F.lit(0))
    others = [c for c in docs.columns if c not in (text_col, "_n_entities")]
    have = docs.where(text.rlike(ENTITY)).withColumn(e, any_of(F.lit(ENTITY)))
    # words of titled names, longest first: the text is read for them too
    words = f"filter(flatten(transform(filter({e}, e -> {_kind('e')} = 'name'), e -> slice(split(e,' '),2,2))), w -> length(w) > 1)"
    have = have.withColumn(names, F.expr(f"array_sort(array_distinct({words}), (a,b) -> if(length(a)=length(b), if(a<b,-1,1), length(b)-length(a)))"))
    bare = F.concat(F.lit(ENTITY + r"|(?<![\p{L}\d])(?:"), F.array_join(names, "|"), F.lit(r")(?![\p{L}\d])"))
    have = have.withColumn(pattern, F.when(F.size(names) > 0, bare).otherwise(F.lit(ENTITY)))
    have = have.select(*others, F.monotonically_increasing_id().alias(row), any_of(F.col(pattern)).alias(e), F.split(text, F.col(pattern), -1).alias(rest))
    have = stored(have, "entities")  # from here on a row keeps its number
    parts = have.select(F.col(row).alias("r"), F.col(e).alias("e")).withColumn("cs", F.expr(f"transform(e, x -> {_parts('x')})"))
    parts = parts.withColumn("names", F.expr("filter(flatten(cs), z -> startswith(z.k,'given:') or startswith(z.k,'surname:'))"))
    mention = "get(filter(names, z -> z.c = lower(e[p])), 0)"
    parts = parts.select("r", F.posexplode(F.expr(f"transform(cs, (x,p) -> if(size(x)=0, array({mention}), x))")).alias("p", "cs"))
    parts = stored(parts.select("r", "p", F.posexplode("cs").alias("q", "kc")).select("r", "p", "q", "kc.k", "kc.c"), "components")
    # the surrogates of an entity follow one another by q: sorting (p, q, s) lines them up with the entities
    done = join_hot(parts, mapping(parts, key), ["k", "c"], "n").groupBy("r").agg(F.array_sort(F.collect_list(F.struct("p", "q", "s"))).alias("m"))
    both = have.join(done.select(F.col("r").alias(r), F.col("m").alias(m)), F.col(row) == F.col(r))
    new = f"transform({e}, (e,p)->transform(array(transform(filter({m}, z->z.p=p), z->z.s)), s->{_render('e', 's')})[0])"
    merged = F.expr(f"concat({rest}[0], array_join(zip_with({new}, slice({rest},2,size({e})), (a,b)->concat(a,b)),''))")
    out = both.select(*(merged.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "_n_entities"), F.size(e).cast("long").alias("_n_entities"))
    plain = docs.where(~text.rlike(ENTITY)).select(*(text.alias(c) if c == text_col else F.col(c) for c in docs.columns if c != "_n_entities"), F.lit(0).cast("long").alias("_n_entities"))
    return plain.unionAll(out)
