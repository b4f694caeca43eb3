"""Signature rules of the license scan.

Texts are matched as lower-case words joined by one blank, so a rule needs no
punctuation: "Version 2.0" reads ``version 2 0``. A rule begins at a distinctive
word, its keyword, under which it is filed; it must end at a word's end.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Rule:
    keyword: str
    pattern: str
    label: str
    priority: int  # 0: base phrase, 1: exact license, 2: family, 3: mention
    score: float


_SCORES = {0: 0.9, 1: 1.0, 2: 0.75, 3: 0.4}
_V = "(?:version |v ?)?"

# The base phrases.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

# One rule a line, priority, label, pattern; the earlier of two
# equally strong rules on the same words wins.
_TEXT = f"""
1 apache-2.0 apache (?:software )?license {_V}2(?: 0)?
1 apache-1.1 apache (?:software )?license {_V}1 1
1 apache-1.0 apache (?:software )?license {_V}1 0
1 apache-2.0 apache 2 0(?: licen[sc]ed?)?
1 apache-2.0 apache2(?: licen[sc]e)?
1 apache-2.0 asl 2 0
1 apache-2.0 apachev2
2 apache apache (?:software |public |open source )?license
1 mit mit license
1 mit mit licen[sc]ed
1 mit mit open source license
1 mit expat license
1 mit-modern mit modern variant
1 mit-0 mit no attribution(?: license)?
1 mit-0 mit 0
1 x11 x11 license
1 x11 mit x11(?: license)?
1 mit permission is hereby granted free of charge to any person obtaining a copy
2 x11 x consortium license
1 bsd-2-clause bsd 2 clause(?: (?:simplified|freebsd))?(?: licen[sc]ed?)?
1 bsd-2-clause simplified bsd(?: license)?
1 bsd-2-clause freebsd license
1 bsd-3-clause bsd 3 clause(?: (?:new|revised|modified|clear))?(?: licen[sc]ed?)?
1 bsd-3-clause new bsd(?: license)?
1 bsd-3-clause revised bsd(?: license)?
1 bsd-3-clause modified bsd(?: license)?
1 bsd-3-clause three clause bsd(?: license)?
1 bsd-2-clause two clause bsd(?: license)?
1 bsd-4-clause bsd 4 clause(?: licen[sc]ed?)?
1 bsd-4-clause original bsd(?: license)?
1 bsd-1-clause bsd 1 clause(?: license)?
1 bsd-2-clause-patent bsd 2 clause (?:plus )?patent(?: license)?
1 bsd-3-clause-clear bsd 3 clause clear(?: license)?
1 bsd-protection bsd protection license
1 0bsd 0bsd
1 0bsd bsd zero clause(?: license)?
1 0bsd zero clause bsd(?: license)?
2 bsd bsd (?:style )?licen[sc]ed?
2 bsd bsd style
2 bsd redistribution and use in source and binary forms(?: with or without modification)?
1 gpl-1.0 gnu general public license {_V}1(?: 0)?
1 gpl-2.0 gnu general public license {_V}2(?: 0)?
1 gpl-3.0 gnu general public license {_V}3(?: 0)?
1 gpl-2.0-or-later gnu general public license {_V}2(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
1 gpl-3.0-or-later gnu general public license {_V}3(?: 0)? or (?:at your option )?(?:any )?later(?: version)?
1 gpl-2.0 gnu gpl {_V}2(?: 0)?
1 gpl-3.0 gnu gpl {_V}3(?: 0)?
1 gpl-2.0 gpl {_V}2(?: 0)?(?: only)?
1 gpl-3.0 gpl {_V}3(?: 0)?(?: only)?
1 gpl-2.0-or-later gpl {_V}2(?: 0)? or later
1 gpl-3.0-or-later gpl {_V}3(?: 0)? or later
1 gpl-2.0 gplv2
1 gpl-3.0 gplv3
1 gpl-2.0 gpl2
1 gpl-3.0 gpl3
1 gpl-2.0-classpath gpl 2 0 with classpath exception
1 gpl-3.0-gcc gpl 3 0 with gcc exception
1 classpath-exception classpath exception(?: 2 0)?
1 gcc-exception gcc runtime library exception(?: 3 1)?
1 openssl-exception openssl exception
1 llvm-exception llvm exceptions?
2 gpl gnu general public licen[sc]e
2 gpl gnu gpl
2 gpl gnu public license
1 lgpl-2.0 gnu library general public license {_V}2(?: 0)?
1 lgpl-2.1 gnu lesser general public license {_V}2 1
1 lgpl-3.0 gnu lesser general public license {_V}3(?: 0)?
1 lgpl-2.0 lgpl {_V}2(?: 0)?
1 lgpl-2.1 lgpl {_V}2 1
1 lgpl-3.0 lgpl {_V}3(?: 0)?
1 lgpl-2.1 lgplv2 1
1 lgpl-3.0 lgplv3
2 lgpl gnu (?:lesser|library) general public license
2 lgpl gnu lgpl
2 lgpl lgpl
2 lgpl lesser general public license
2 lgpl library general public license
1 agpl-3.0 gnu affero general public license {_V}3(?: 0)?
1 agpl-1.0 affero general public license {_V}1(?: 0)?
1 agpl-3.0 affero general public license {_V}3(?: 0)?
1 agpl-3.0 agpl {_V}3(?: 0)?(?: only| or later)?
1 agpl-3.0 agplv3
2 agpl gnu affero general public license
2 agpl affero general public license
2 agpl gnu agpl
1 gfdl-1.1 gnu free documentation license {_V}1 1
1 gfdl-1.2 gnu free documentation license {_V}1 2
1 gfdl-1.3 gnu free documentation license {_V}1 3
2 gfdl gnu free documentation license
2 gfdl gfdl
1 gnu-all-permissive gnu all permissive license
1 mpl-1.0 mozilla public license {_V}1 0
1 mpl-1.1 mozilla public license {_V}1 1
1 mpl-2.0 mozilla public license {_V}2(?: 0)?
1 mpl-1.1 mpl {_V}1 1
1 mpl-2.0 mpl {_V}2(?: 0)?
2 mpl mozilla public license
1 epl-1.0 eclipse public license {_V}1(?: 0)?
1 epl-2.0 eclipse public license {_V}2(?: 0)?
1 epl-1.0 epl {_V}1 0
1 epl-2.0 epl {_V}2 0
1 edl-1.0 eclipse distribution license(?: {_V}1 0)?
2 epl eclipse public license
1 cpl-1.0 common public license(?: {_V}1 0)?
1 ipl-1.0 ibm public license(?: {_V}1 0)?
1 cddl-1.0 common development and distribution license {_V}1 0
1 cddl-1.1 common development and distribution license {_V}1 1
2 cddl common development and distribution license
1 cddl-1.0 cddl {_V}1 0
1 cddl-1.1 cddl {_V}1 1
1 cpal-1.0 common public attribution license(?: {_V}1 0)?
1 cc-by-4.0 cc by 4 0(?: international)?
1 cc-by-3.0 cc by 3 0(?: unported)?
1 cc-by-2.5 cc by 2 5
1 cc-by-2.0 cc by 2 0
1 cc-by-1.0 cc by 1 0
1 cc-by-sa-4.0 cc by sa 4 0(?: international)?
1 cc-by-sa-3.0 cc by sa 3 0(?: unported)?
1 cc-by-sa-2.5 cc by sa 2 5
1 cc-by-sa-2.0 cc by sa 2 0
1 cc-by-nc-4.0 cc by nc 4 0(?: international)?
1 cc-by-nc-3.0 cc by nc 3 0(?: unported)?
1 cc-by-nc-2.5 cc by nc 2 5
1 cc-by-nc-2.0 cc by nc 2 0
1 cc-by-nd-4.0 cc by nd 4 0(?: international)?
1 cc-by-nd-3.0 cc by nd 3 0(?: unported)?
1 cc-by-nc-sa-4.0 cc by nc sa 4 0(?: international)?
1 cc-by-nc-sa-3.0 cc by nc sa 3 0(?: unported)?
1 cc-by-nc-nd-4.0 cc by nc nd 4 0(?: international)?
1 cc-by-nc-nd-3.0 cc by nc nd 3 0(?: unported)?
2 cc-by-nc-sa cc by nc sa
2 cc-by-nc-nd cc by nc nd
2 cc-by-sa cc by sa
2 cc-by-nc cc by nc
2 cc-by-nd cc by nd
2 cc-by cc by
1 cc-by-4.0 creative commons attribution 4 0(?: international)?(?: public)?(?: license)?
1 cc-by-3.0 creative commons attribution 3 0(?: unported)?(?: license)?
1 cc-by-sa-4.0 creative commons attribution share ?alike 4 0(?: international)?(?: public)?(?: license)?
1 cc-by-sa-3.0 creative commons attribution share ?alike 3 0(?: unported)?(?: license)?
1 cc-by-nc-4.0 creative commons attribution non ?commercial 4 0(?: international)?(?: public)?(?: license)?
1 cc-by-nd-4.0 creative commons attribution no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: license)?
1 cc-by-nc-sa-4.0 creative commons attribution non ?commercial share ?alike 4 0(?: international)?(?: public)?(?: license)?
1 cc-by-nc-nd-4.0 creative commons attribution non ?commercial no ?deriv(?:ative)?s 4 0(?: international)?(?: public)?(?: license)?
2 cc-by-nc-sa creative commons attribution non ?commercial share ?alike
2 cc-by-nc-nd creative commons attribution non ?commercial no ?deriv(?:ative)?s
2 cc-by-sa creative commons attribution share ?alike
2 cc-by-nc creative commons attribution non ?commercial
2 cc-by-nd creative commons attribution no ?deriv(?:ative)?s
2 cc-by creative commons attribution
3 creative-commons creative commons(?: licen[sc]e)?
1 cc0-1.0 cc0(?: 1 0)?(?: universal)?
1 cc0-1.0 creative commons zero(?: {_V}1 0)?(?: universal)?
1 cc0-1.0 cc zero
1 cc-pddc public domain dedication(?: and certification)?
1 cc-pdm-1.0 public domain mark(?: 1 0)?
3 public-domain public domain
1 isc isc license
1 isc permission to use copy modify and or distribute this software for any purpose
1 hpnd permission to use copy modify (?:and )?distribute this software and its documentation
1 zlib zlib license
1 zlib zlib libpng license
1 libpng libpng license(?: {_V}2)?
1 unlicense unlicense
1 unlicense unencumbered software released into the public domain
1 wtfpl wtfpl
1 beerware beer ?ware license
1 beerware beerware
1 artistic-1.0 artistic license {_V}1(?: 0)?
1 artistic-2.0 artistic license {_V}2(?: 0)?
2 artistic artistic license
1 clartistic clarified artistic license
1 psf-2.0 python software foundation license(?: {_V}2)?
1 psf-2.0 psf license(?: agreement)?
1 python-2.0 python license 2 0
1 cnri-python cnri python license
1 php-3.0 php license {_V}3 0
1 php-3.01 php license {_V}3 01
2 php php license
1 ruby ruby license
1 openssl openssl license
1 ssleay ssleay license
1 curl curl license
1 tcl tcl tk license
1 postgresql postgresql license
1 bsl-1.0 boost software license(?: {_V}1 0)?
1 afl-2.1 academic free license {_V}2 1
1 afl-3.0 academic free license {_V}3 0
2 afl academic free license
1 osl-1.0 open software license {_V}1 0
1 osl-2.1 open software license {_V}2 1
1 osl-3.0 open software license {_V}3 0
2 osl open software license
1 ms-pl microsoft public license
1 ms-rl microsoft reciprocal license
1 ms-lpl microsoft limited public license
1 eupl-1.1 european union public licen[sc]e {_V}1 1
1 eupl-1.2 european union public licen[sc]e {_V}1 2
2 eupl european union public licen[sc]e
1 eupl-1.1 eupl {_V}1 1
1 eupl-1.2 eupl {_V}1 2
1 cecill-2.1 cecill {_V}2 1
1 cecill-b cecill b
1 cecill-c cecill c
2 cecill cecill(?: license)?
1 odbl-1.0 open database license(?: {_V}1 0)?
1 odbl-1.0 odbl(?: 1 0)?
1 odc-by-1.0 open data commons attribution license(?: {_V}1 0)?
1 odc-by-1.0 odc by(?: 1 0)?
1 pddl-1.0 open data commons public domain dedication
1 pddl-1.0 pddl
1 ogl-1.0 open government licen[sc]e {_V}1(?: 0)?
1 ogl-2.0 open government licen[sc]e {_V}2(?: 0)?
1 ogl-3.0 open government licen[sc]e {_V}3(?: 0)?
2 ogl open government licen[sc]e
1 cdla-permissive-2.0 community data license agreement permissive(?: {_V}2 0)?
1 cdla-sharing-1.0 community data license agreement sharing(?: {_V}1 0)?
1 ofl-1.0 sil open font license {_V}1 0
1 ofl-1.1 sil open font license {_V}1 1
2 ofl sil open font license
2 ofl open font license
1 ubuntu-font-1.0 ubuntu font licen[sc]e(?: {_V}1 0)?
1 lppl-1.3c latex project public license {_V}1 3c
2 lppl latex project public license
1 ncsa university of illinois ncsa open source license
1 ncsa ncsa open source license
1 w3c w3c software (?:notice and )?(?:and document )?license
1 spl-1.0 sun public license(?: {_V}1 0)?
1 npl-1.1 netscape public license {_V}1 1
2 npl netscape public license
1 nokia nokia open source license
1 qpl-1.0 q public license(?: {_V}1 0)?
1 sleepycat sleepycat license
1 vim vim license
1 json json license
1 apsl-2.0 apple public source license(?: {_V}2(?: 0)?)?
1 rpl-1.5 reciprocal public license(?: {_V}1 5)?
1 upl-1.0 universal permissive license(?: {_V}1 0)?
1 blueoak-1.0.0 blue oak model license(?: 1 0 0)?
1 mulan-psl-2.0 mulan permissive software license(?: {_V}2)?
1 ecl-2.0 educational community license(?: {_V}2 0)?
1 zpl-2.1 zope public license(?: {_V}2 1)?
1 busl-1.1 business source license(?: {_V}1 1)?
1 sspl-1.0 server side public license(?: {_V}1(?: 0)?)?
1 elastic-2.0 elastic license(?: {_V}?2 0)?
1 rsal redis source available license
1 commons-clause commons clause
1 polyform-noncommercial polyform noncommercial license
1 polyform-small-business polyform small business license
1 hippocratic hippocratic license
1 confluent confluent community license
1 timescale timescale license
1 llama-community llama [23] community license
1 openrail (?:bigscience )?openrail(?: m)?
1 bigscience-rail bigscience rail license
1 rail responsible ai license
1 gemma gemma terms of use
1 fair-source fair source license
3 spdx spdx license identifier
3 dual-license dual licensed
3 warranty-disclaimer without warranty of any kind
3 warranty-disclaimer without warranties or conditions of any kind
3 warranty-disclaimer provided as is without (?:any )?(?:express or implied )?warrant(?:y|ies)
3 non-commercial non commercial use only
3 non-commercial noncommercial use only
3 some-rights-reserved some rights reserved
3 no-rights-reserved no rights reserved
3 proprietary proprietary and confidential
3 proprietary confidential and proprietary
3 restricted may not be reproduced
3 restricted unauthorized (?:copying|reproduction|distribution)(?: of this file)?
3 copyright copyright (?:c )?(?:19|20)[0-9][0-9]
3 copyright copyrighted material
3 license-mention licen[sc]ed under
3 license-mention released under
3 license-mention distributed under
3 license-mention terms of the license
3 license-mention license agreement
3 license-mention open source license
"""


def _parse() -> tuple[Rule, ...]:
    found = [Rule(phrase.split(" ")[0], phrase, label, 0, _SCORES[0]) for phrase, label in BASE]
    for line in filter(None, map(str.strip, _TEXT.split("\n"))):
        priority, label, pattern = line.split(" ", 2)
        first = pattern.split(" ")[0]
        for keyword in _spelled(first):
            found.append(Rule(keyword, pattern, label, int(priority), _SCORES[int(priority)]))
    return tuple(found)


def _spelled(first: str) -> list[str]:
    """The words that a rule's first word stands for."""
    for short, long in (("licen[sc]ed", ("licensed", "licenced")), 
                        ("(?:bigscience", ("bigscience", "openrail"))):
        if first == short:
            return list(long)
    return [first.split("(")[0]]


RULES = _parse()
# Keywords that are common words. They count only before the second word of a rule.
COMMON = frozenset("all business common community fair general library may new no non open public some sun terms three two without".split())
KEYWORDS = tuple(sorted({r.keyword for r in RULES} - COMMON))
PAIRS = tuple(sorted({" ".join(r.pattern.split(" ")[:2]).split("(")[0] for r in RULES if r.keyword in COMMON}))
