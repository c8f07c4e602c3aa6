"""Signatures of licence notices, written by hand: tier | keyword | label | words.

A document's words are matched one by one, so a pattern is a row of words, each of them a regular expression of its
own. [x] is an optional word, {n} up to n words of any kind. The keyword must occur as a word wherever the pattern
matches. Tier 5: the text of a grant; 4: a notice with a version; 3: a notice; 2: a name; 1: a hint.
"""

from __future__ import annotations

import re
from typing import NamedTuple

#: Phrases that count as base places, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

TABLE = """
5|permission|mit|permission is hereby granted free of charge to any person obtaining a copy
5|merge|mit|to use copy modify merge publish distribute sublicense and or sell copies of the software
5|portions|mit|the above copyright notice and this permission notice shall be included in all copies or substantial portions
5|authors|mit|in no event shall the authors or copyright holders be liable for any claim damages or other liability
4|mit|mit|spdx license identifier mit
3|mit|mit|under the mit license
3|mit|mit|under [the] [terms] [of] [the] mit (?:license|licence)
3|mit|mit|(?:released|licensed|distributed|available|published) under [the] [terms] [of] [the] mit
3|mit|mit|licensed {3} mit (?:license|licence)
3|mit|mit|(?:license|licence) mit
2|mit|mit|the mit (?:license|licence)
2|mit|mit|mit (?:license|licence)
2|mit|mit|mit licensed
1|mit|mit|mit style (?:license|licence)
4|mit|mit-0|spdx license identifier mit 0
4|mit|mit-0|mit no attribution
3|expat|mit|[the] expat (?:license|licence)
3|x11|x11|(?:under|the) x11 (?:license|licence)
2|x11|x11|x11 (?:license|licence)
4|apache|apache-2|apache license version 2
4|apache|apache-2.0|[the] apache (?:license|licence) [version] 2 0
4|apache|apache-2.0|licensed under the apache (?:license|licence) version 2 0 the (?:license|licence)
4|apache|apache-2.0|spdx license identifier apache 2 0
4|apache|apache-2.0|apache 2 0 (?:license|licence)
3|apache|apache-2.0|(?:under|the) apache 2 0
3|apache|apache-2.0|apache (?:v2|2) (?:license|licence)
3|apache|apache-2.0|apache (?:license|licence) v2
3|apache|apache-2.0|asl 2 0 apache
4|apache|apache-1.1|apache [software] [license] version 1 1
4|apache|apache-1.1|apache (?:license|licence) [version] 1 1
4|apache|apache-1.0|apache (?:license|licence) [version] 1 0
3|apache|apache|under the apache (?:license|licence)
2|apache|apache|apache software (?:license|licence)
2|apache|apache|apache (?:license|licence)
5|compliance|apache-2.0|you may not use this file except in compliance with the (?:license|licence)
5|conditions|apache-2.0|without warranties or conditions of any kind either express or implied
5|hereby|apache-2.0|each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable
4|licenses|apache-2.0|apache org licenses license 2 0
4|gpl|gpl-1.0|spdx license identifier gpl 1 0
4|gpl|gpl-2.0-only|spdx license identifier gpl 2 0 [only]
4|gpl|gpl-2.0-or-later|spdx license identifier gpl 2 0 or later
4|gpl|gpl-3.0-only|spdx license identifier gpl 3 0 [only]
4|gpl|gpl-3.0-or-later|spdx license identifier gpl 3 0 or later
4|gpl|gpl-2.0|gpl [version] 2 0
4|gpl|gpl-3.0|gpl [version] 3 0
4|gpl|gpl-2.0|gpl (?:v2|version) [2]
4|gpl|gpl-3.0|gpl v3
4|gplv2|gpl-2.0|gplv2
4|gplv3|gpl-3.0|gplv3
3|gpl|gpl|(?:under|the) [the] gnu gpl
3|gpl|gpl|(?:released|licensed|distributed) under [the] [terms] [of] [the] gpl
2|gpl|gpl|gpl (?:license|licence|licensed)
2|gpl|gpl|gnu gpl
4|gnu|gpl-1.0|gnu general public (?:license|licence) version 1
4|gnu|gpl-2.0|gnu general public (?:license|licence) [as] {5} version 2 [of]
4|gnu|gpl-3.0|gnu general public (?:license|licence) [as] {5} version 3 [of]
4|gnu|gpl-2.0|gnu general public (?:license|licence) v2
4|gnu|gpl-3.0|gnu general public (?:license|licence) v3
3|gnu|gpl|under the terms of the gnu general public (?:license|licence)
2|gnu|gpl|gnu general public (?:license|licence)
5|redistribute|gpl|you can redistribute it and or modify it under the terms of the gnu general public (?:license|licence)
5|merchantability|gpl|without even the implied warranty of merchantability or fitness for a particular purpose
5|foundation|gpl|as published by the free software foundation either version
3|foundation|gpl|free software foundation inc
3|copyleft|copyleft|copyleft (?:license|licence)
4|lgpl|lgpl-2.0|lgpl [version] 2 0
4|lgpl|lgpl-2.1|lgpl [version] 2 1
4|lgpl|lgpl-3.0|lgpl [version] 3 0
4|lgpl|lgpl-2.1|spdx license identifier lgpl 2 1 [only]
4|lgpl|lgpl-3.0|spdx license identifier lgpl 3 0 [only]
4|lgplv3|lgpl-3.0|lgplv3
4|lgplv2|lgpl-2.0|lgplv2
3|lgpl|lgpl|(?:under|the) [the] [gnu] lgpl
2|lgpl|lgpl|gnu lgpl
4|lesser|lgpl-2.1|gnu lesser general public (?:license|licence) [as] {5} version 2 1
4|lesser|lgpl-3.0|gnu lesser general public (?:license|licence) [as] {5} version 3
3|lesser|lgpl|under the terms of the gnu lesser general public (?:license|licence)
2|lesser|lgpl|gnu lesser general public (?:license|licence)
4|library|lgpl-2.0|gnu library general public (?:license|licence) [as] {5} version 2
2|library|lgpl|gnu library general public (?:license|licence)
4|agpl|agpl-3.0|agpl [version] 3 0
4|agpl|agpl-3.0|agpl v3
4|agpl|agpl-3.0|spdx license identifier agpl 3 0
4|agplv3|agpl-3.0|agplv3
3|agpl|agpl|(?:under|the) [the] [gnu] agpl
4|affero|agpl-3.0|gnu affero general public (?:license|licence) [as] {5} version 3
3|affero|agpl|under the terms of the gnu affero general public (?:license|licence)
2|affero|agpl|gnu affero general public (?:license|licence)
2|affero|agpl|affero general public (?:license|licence)
4|fdl|gfdl|gnu fdl [version] 1 [1-3]
3|documentation|gfdl|gnu free documentation (?:license|licence) version 1 [1-3]
2|documentation|gfdl|gnu free documentation (?:license|licence)
5|invariant|gfdl|with no invariant sections no front cover texts and no back cover texts
4|0bsd|bsd-0-clause|spdx license identifier 0bsd
4|bsd|bsd-2-clause|spdx license identifier bsd 2 clause
4|bsd|bsd-3-clause|spdx license identifier bsd 3 clause
4|bsd|bsd-4-clause|spdx license identifier bsd 4 clause
4|bsd|bsd-2-clause|bsd 2 clause
4|bsd|bsd-3-clause|bsd 3 clause
4|bsd|bsd-4-clause|bsd 4 clause
4|bsd|bsd-2-clause|2 clause bsd
4|bsd|bsd-3-clause|3 clause bsd
4|bsd|bsd-4-clause|4 clause bsd
4|bsd|bsd-2-clause|simplified bsd
4|freebsd|bsd-2-clause|freebsd (?:license|licence)
4|bsd|bsd-3-clause|(?:new|revised|modified) bsd
4|bsd|bsd-4-clause|(?:old|original) bsd
3|bsd|bsd|under [the] [terms] [of] [the] [a] bsd [style] (?:license|licence)
3|bsd|bsd|(?:released|licensed|distributed) under [the] bsd
2|bsd|bsd|bsd (?:license|licence|licensed)
1|bsd|bsd|bsd style
5|binary|bsd|redistribution and use in source and binary forms with or without modification are permitted
5|retain|bsd|redistributions of source code must retain the above copyright notice
5|reproduce|bsd|redistributions in binary form must reproduce the above copyright notice
5|endorse|bsd-3-clause|may be used to endorse or promote products derived from this software
5|advertising|bsd-4-clause|all advertising materials mentioning features or use of this software must display
4|isc|isc|spdx license identifier isc
3|isc|isc|(?:under|the) [the] isc (?:license|licence)
2|isc|isc|isc (?:license|licence)
5|purpose|isc|permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
4|mpl|mpl-1.1|mpl [version] 1 1
4|mpl|mpl-2.0|mpl [version] 2 0
4|mpl|mpl-2.0|spdx license identifier mpl 2 0
3|mpl|mpl|(?:under|the) [the] mpl
4|mozilla|mpl-1.0|mozilla public (?:license|licence) [version] 1 0
4|mozilla|mpl-1.1|mozilla public (?:license|licence) [version] 1 1
4|mozilla|mpl-2.0|mozilla public (?:license|licence) [v] [version] 2 0
5|mozilla|mpl-2.0|this source code form is subject to the terms of the mozilla public (?:license|licence)
3|mozilla|mpl|under the mozilla public (?:license|licence)
2|mozilla|mpl|mozilla public (?:license|licence)
4|epl|epl-1.0|epl [version] 1 0
4|epl|epl-2.0|epl [version] 2 0
4|epl|epl-2.0|spdx license identifier epl 2 0
4|eclipse|epl-1.0|eclipse public (?:license|licence) [v] [version] 1 0
4|eclipse|epl-2.0|eclipse public (?:license|licence) [v] [version] 2 0
2|eclipse|epl|eclipse public (?:license|licence)
4|eclipse|edl-1.0|eclipse distribution (?:license|licence) [v] [version] 1 0
2|eclipse|edl|eclipse distribution (?:license|licence)
4|cddl|cddl-1.0|cddl [version] 1 0
4|cddl|cddl-1.1|cddl [version] 1 1
2|cddl|cddl|cddl
4|development|cddl-1.0|common development and distribution (?:license|licence) [v] [version] 1 0
2|development|cddl|common development and distribution (?:license|licence)
4|common|cpl-1.0|common public (?:license|licence) [v] [version] 1 0
2|common|cpl|common public (?:license|licence)
4|eupl|eupl-1.1|eupl [v] [version] 1 1
4|eupl|eupl-1.2|eupl [v] [version] 1 2
2|eupl|eupl|eupl
2|union|eupl|european union public (?:license|licence)
4|artistic|artistic-1.0|artistic (?:license|licence) [version] 1 0
4|artistic|artistic-2.0|artistic (?:license|licence) [version] 2 0
2|artistic|artistic|artistic (?:license|licence)
4|perl|perl|under the same terms as perl [itself]
4|zlib|zlib|spdx license identifier zlib
3|zlib|zlib|zlib (?:license|licence)
3|zlib|zlib|zlib libpng (?:license|licence)
2|libpng|libpng|libpng (?:license|licence)
5|misrepresented|zlib|the origin of this software must not be misrepresented
5|altered|zlib|altered source versions must be plainly marked as such
4|boost|bsl-1.0|boost software (?:license|licence) [version] 1 0
4|bsl|bsl-1.0|spdx license identifier bsl 1 0
2|boost|bsl-1.0|boost software (?:license|licence)
4|unlicense|unlicense|spdx license identifier unlicense
3|unlicense|unlicense|[the] unlicense
5|unencumbered|unlicense|this is free and unencumbered software released into the public domain
4|wtfpl|wtfpl|wtfpl [version] [2]
4|fuck|wtfpl|do what the fuck you want to public (?:license|licence)
3|domain|public-domain|(?:released|placed|dedicated) {2} public domain
3|domain|public-domain|(?:in|into|to) the public domain
2|domain|public-domain|public domain dedication
4|cc0|cc0-1.0|cc0 1 0 [universal]
4|cc0|cc0-1.0|spdx license identifier cc0 1 0
2|cc0|cc0|cc0
4|zero|cc0-1.0|creative commons zero v?1 [0] [universal]
2|zero|cc0|creative commons zero
3|cc|cc-by-nc|cc by nc
4|cc|cc-by-nc-4.0|cc by nc 4 0
4|cc|cc-by-nc-3.0|cc by nc 3 0
4|cc|cc-by-nc-2.5|cc by nc 2 5
4|cc|cc-by-nc-2.0|cc by nc 2 0
4|cc|cc-by-nc-1.0|cc by nc 1 0
4|cc|cc-by-nc-sa-4.0|cc by nc sa 4 0
4|cc|cc-by-nc-sa-3.0|cc by nc sa 3 0
4|cc|cc-by-nc-sa-2.5|cc by nc sa 2 5
4|cc|cc-by-nc-sa-2.0|cc by nc sa 2 0
3|cc|cc-by-nc-sa|cc by nc sa
4|cc|cc-by-nc-nd-4.0|cc by nc nd 4 0
4|cc|cc-by-nc-nd-3.0|cc by nc nd 3 0
4|cc|cc-by-nc-nd-2.5|cc by nc nd 2 5
4|cc|cc-by-nc-nd-2.0|cc by nc nd 2 0
3|cc|cc-by-nc-nd|cc by nc nd
4|cc|cc-by-sa-4.0|cc by sa 4 0
4|cc|cc-by-sa-3.0|cc by sa 3 0
4|cc|cc-by-sa-2.5|cc by sa 2 5
4|cc|cc-by-sa-2.0|cc by sa 2 0
3|cc|cc-by-sa|cc by sa
4|cc|cc-by-nd-4.0|cc by nd 4 0
4|cc|cc-by-nd-3.0|cc by nd 3 0
3|cc|cc-by-nd|cc by nd
4|cc|cc-by-4.0|cc by 4 0
4|cc|cc-by-3.0|cc by 3 0
4|cc|cc-by-2.5|cc by 2 5
4|cc|cc-by-2.0|cc by 2 0
4|cc|cc-by-1.0|cc by 1 0
2|cc|cc-by|cc by
2|cc|cc|cc (?:license|licence|licensed)
4|creative|cc-by-4.0|creative commons attribution 4 0
4|creative|cc-by-3.0|creative commons attribution 3 0
4|creative|cc-by-2.0|creative commons attribution 2 0
3|creative|cc-by|creative commons attribution
4|creative|cc-by-sa-4.0|creative commons attribution sharealike 4 0
4|creative|cc-by-sa-3.0|creative commons attribution sharealike 3 0
3|creative|cc-by-sa|creative commons attribution (?:sharealike|share) [alike]
4|creative|cc-by-nc-4.0|creative commons attribution (?:noncommercial|non) [commercial] 4 0
4|creative|cc-by-nc-3.0|creative commons attribution (?:noncommercial|non) [commercial] 3 0
3|creative|cc-by-nc|creative commons attribution (?:noncommercial|non) [commercial]
3|creative|cc-by-nc-sa|creative commons attribution (?:noncommercial|non) [commercial] (?:sharealike|share) [alike]
3|creative|cc-by-nc-nd|creative commons attribution (?:noncommercial|non) [commercial] (?:noderivatives|noderivs|no) [derivatives]
3|creative|cc-by-nd|creative commons attribution (?:noderivatives|noderivs|no) [derivatives]
2|creative|cc|creative commons (?:license|licence)
2|creative|cc|creative commons
4|creativecommons|cc-by|creativecommons org licenses by
4|creativecommons|cc-by-sa|creativecommons org licenses by sa
4|creativecommons|cc-by-nc|creativecommons org licenses by nc
4|creativecommons|cc-by-nc-sa|creativecommons org licenses by nc sa
4|creativecommons|cc-by-nd|creativecommons org licenses by nd
4|creativecommons|cc-by-nc-nd|creativecommons org licenses by nc nd
4|creativecommons|cc0|creativecommons org publicdomain zero
2|creativecommons|cc|creativecommons org
4|odbl|odbl-1.0|odbl [v] [version] 1 0
2|odbl|odbl|odbl
3|database|odbl|open (?:data|database) [commons] open database (?:license|licence)
2|database|odbl|open database (?:license|licence)
3|odc|odc-by|odc by
3|pddl|pddl|pddl
3|attribution|odc-by|open data commons attribution (?:license|licence)
4|government|ogl|open government (?:license|licence) [v] [version] [1-3]
3|ogl|ogl|ogl v?[1-3] [0]
4|openrail|openrail|(?:bigscience|creativeml) openrail [m]
2|openrail|openrail|openrail
3|rail|rail|rail (?:license|licence)
4|llama|llama|llama [2-4] community (?:license|licence)
3|llama|llama|llama community (?:license|licence)
3|gemma|gemma|gemma terms of use
4|business|busl-1.1|business source (?:license|licence) [version] 1 1
2|business|busl|business source (?:license|licence)
4|busl|busl-1.1|spdx license identifier busl 1 1
4|sspl|sspl-1.0|sspl [v] [version] 1 [0]
2|sspl|sspl|sspl
2|server|sspl|server side public (?:license|licence)
4|elastic|elastic-2.0|elastic (?:license|licence) [v] [version] 2 [0]
2|elastic|elastic|elastic (?:license|licence)
3|commons|commons-clause|commons clause (?:license|licence|restriction)
4|openssl|openssl|openssl (?:license|licence)
3|ssleay|ssleay|ssleay (?:license|licence)
4|python|psf-2.0|python software foundation (?:license|licence) [version] [2]
3|psf|psf|psf (?:license|licence)
3|php|php-3.01|php (?:license|licence) [v] [version] 3 (?:0|01)
2|php|php|php (?:license|licence)
3|ruby|ruby|under the same terms as ruby
2|ruby|ruby|ruby (?:license|licence)
3|ofl|ofl-1.1|(?:sil|the) ofl [version] 1 1
4|font|ofl-1.1|sil open font (?:license|licence) [version] 1 1
2|font|ofl|open font (?:license|licence)
3|ncsa|ncsa|university of illinois ncsa open source (?:license|licence)
2|ncsa|ncsa|ncsa (?:license|licence)
3|postgresql|postgresql|postgresql (?:license|licence)
3|w3c|w3c|w3c software {2} (?:license|licence)
2|w3c|w3c|w3c (?:license|licence)
3|unicode|unicode|unicode (?:license|licence) [v] [3]
3|unicode|unicode|unicode inc (?:license|licence) agreement
3|json|json|the json (?:license|licence)
5|evil|json|the software shall be used for good not evil
3|beerware|beerware|[the] beerware (?:license|licence)
3|beer|beerware|the beer ware (?:license|licence)
3|vim|vim|vim (?:license|licence)
3|curl|curl|curl (?:license|licence)
3|ecl|ecl-2.0|ecl [version] 2 0
3|educational|ecl-2.0|educational community (?:license|licence) [version] 2 0
3|afl|afl-3.0|afl [version] 3 0
3|academic|afl|academic free (?:license|licence)
3|osl|osl-3.0|osl [version] 3 0
2|open|osl|open software (?:license|licence)
3|public|qpl|q public (?:license|licence)
3|ms|ms-pl|ms pl
3|ms|ms-rl|ms rl
2|microsoft|ms-pl|microsoft public (?:license|licence)
2|microsoft|ms-rl|microsoft reciprocal (?:license|licence)
2|ibm|ipl-1.0|ibm public (?:license|licence)
2|intel|intel|intel open source (?:license|licence)
2|nokia|nokia|nokia open source (?:license|licence)
2|sun|sun-public|sun public (?:license|licence)
2|apple|apsl|apple public source (?:license|licence)
4|apsl|apsl-2.0|apsl [version] 2 0
2|zope|zpl|zope public (?:license|licence)
2|lucent|lpl|lucent public (?:license|licence)
2|cecill|cecill|cecill [b] [c] [v] [2]
2|mulan|mulanpsl|mulan (?:psl|permissive) [software] [license]
2|blueoak|blueoak|blueoak [1] [0]
2|permissive|upl-1.0|universal permissive (?:license|licence)
2|hippocratic|hippocratic|hippocratic (?:license|licence)
2|polyform|polyform|polyform (?:noncommercial|small|shield|strict) [business]
3|rights|proprietary|all rights reserved
4|confidential|proprietary|proprietary and confidential
4|unauthorized|proprietary|unauthorized (?:copying|reproduction|distribution|use) {4} (?:prohibited|forbidden)
3|reproduced|proprietary|no part {4} may be reproduced
3|written|proprietary|without [the] [prior] [express] written (?:permission|consent)
4|evaluation|proprietary|for evaluation purposes only
4|trade|proprietary|trade secrets? of
2|eula|eula|end user (?:license|licence) agreement eula
2|agreement|eula|end user (?:license|licence) agreement
3|noncommercial|noncommercial|(?:for|is) noncommercial use only
3|commercial|noncommercial|for non commercial use only
3|commercial|noncommercial|not for commercial use
3|research|research-only|for research (?:purposes|use) only
2|shareware|shareware|this {2} shareware
2|freeware|freeware|this {2} freeware
1|licensed|unknown-license|licensed under [the] [terms] [of]
1|released|unknown-license|released under [the] [terms] [of]
1|license|unknown-license|(?:see|read) [the] license [file] [for] [details]
1|license|unknown-license|spdx license identifier
1|copyright|copyright|copyright c [(?:19|20)[0-9][0-9]]
1|copyright|copyright|copyright (?:19|20)[0-9][0-9]
"""


class Rule(NamedTuple):
    rule: int
    tier: int
    keyword: str
    label: str
    pattern: str
    base: bool


def pattern_of(words: str) -> str:
    """A regular expression over text in which each word has a space of its own on either side."""
    out = []
    for word in words.split():
        if gap := re.fullmatch(r"\{(\d+)\}", word):
            out.append(f"(?: [^ ]+ ){{0,{gap[1]}}}")
        elif re.fullmatch(r"\[\d-\d\]", word) or not (word[0] == "[" and word[-1] == "]"):
            out.append(f" (?:{word}) ")
        else:
            out.append(f"(?: (?:{word[1:-1]}) )?")
    return "".join(out)


def rules() -> list[Rule]:
    lines = [line.split("|", 3) for line in TABLE.split("\n") if line]
    return [Rule(k, int(tier), keyword, label, pattern_of(words), BASE.get(words) == label) for k, (tier, keyword, label, words) in enumerate(lines)]
