"""Signature rules of the license scan: label, priority, keyword, regular expression.

Expressions run over ASCII-lower-cased text in which white space is single blanks and "licence" is spelt "license". The
keyword is a plain string that every match contains; a rule is tried only where its keyword occurs. Priority 3: a full identifier or text of the license; 2: its name or address; 1: a family or a
general notice. The order of the list breaks ties.
"""

from __future__ import annotations

import re
from typing import NamedTuple


class Rule(NamedTuple):
    label: str
    priority: int
    keyword: str
    pattern: str


#: Identifiers that may follow "SPDX-License-Identifier:".
SPDX_IDS = """
0bsd aal afl-1.1 afl-1.2 afl-2.0 afl-2.1 afl-3.0 agpl-1.0 agpl-3.0-only agpl-3.0-or-later apache-1.0 apache-1.1 apache-2.0
apsl-1.0 apsl-2.0 artistic-1.0 artistic-2.0 beerware blueoak-1.0.0 bsd-1-clause bsd-2-clause bsd-2-clause-patent
bsd-3-clause bsd-3-clause-clear bsd-4-clause bsl-1.0 busl-1.1 cc-by-1.0 cc-by-2.0 cc-by-2.5 cc-by-3.0 cc-by-4.0
cc-by-nc-2.0 cc-by-nc-3.0 cc-by-nc-4.0 cc-by-nc-nd-3.0 cc-by-nc-nd-4.0 cc-by-nc-sa-3.0 cc-by-nc-sa-4.0 cc-by-nd-3.0
cc-by-nd-4.0 cc-by-sa-2.0 cc-by-sa-2.5 cc-by-sa-3.0 cc-by-sa-4.0 cc0-1.0 cddl-1.0 cddl-1.1 cecill-2.1 cecill-b cecill-c
cpal-1.0 cpl-1.0 ecl-2.0 efl-2.0 elastic-2.0 epl-1.0 epl-2.0 eupl-1.1 eupl-1.2 ftl gfdl-1.1-only gfdl-1.2-only
gfdl-1.3-only gfdl-1.3-or-later gpl-1.0-only gpl-2.0-only gpl-2.0-or-later gpl-3.0-only gpl-3.0-or-later hpnd icu ijg
intel ipl-1.0 isc json lgpl-2.0-only lgpl-2.1-only lgpl-2.1-or-later lgpl-3.0-only lgpl-3.0-or-later libpng-2.0 lppl-1.3c
lpl-1.02 mit mit-0 mpl-1.0 mpl-1.1 mpl-2.0 mpl-2.0-no-copyleft-exception ms-pl ms-rl mulanpsl-2.0 ncsa nosl npl-1.1 odbl-1.0
odc-by-1.0 ofl-1.1 oldap-2.8 openssl osl-3.0 pddl-1.0 php-3.01 postgresql psf-2.0 python-2.0 qpl-1.0 rpl-1.5 ruby
simpl-2.0 sissl sleepycat spl-1.0 sspl-1.0 tcl unicode-3.0 unlicense upl-1.0 vim w3c wtfpl x11 xnet zlib zpl-2.1
""".split()

#: (label, keyword, expression) of names and addresses.
NAMES = [
    ("mit", "mit license", r"\b(?:the )?mit license\b"),
    ("mit", "licenses/mit", r"opensource\.org/licenses/mit(?:-license)?(?:\.php)?"),
    ("mit", "expat", r"\bexpat license\b"),
    ("x11", "x11 license", r"\bx11 license\b"),
    ("apache-2.0", "apache", r"\bapache license,? (?:version|v\.?)? ?2(?:\.0)?\b"),
    ("apache-2.0", "license-2.0", r"apache\.org/licenses/license-2\.0(?:\.txt|\.html)?"),
    ("apache-1.1", "apache", r"\bapache (?:software )?license,? (?:version|v\.?)? ?1\.1\b"),
    ("apache-1.0", "apache", r"\bapache (?:software )?license,? (?:version|v\.?)? ?1\.0\b"),
    ("gpl-3.0", "general public license", r"\bgnu general public license,? (?:as published by the free software foundation,? )?(?:either )?(?:version|v\.?) ?3\b"),
    ("gpl-2.0", "general public license", r"\bgnu general public license,? (?:as published by the free software foundation,? )?(?:either )?(?:version|v\.?) ?2\b"),
    ("gpl-1.0", "general public license", r"\bgnu general public license,? (?:version|v\.?) ?1\b"),
    ("gpl-3.0", "gplv3", r"\bgplv3\+?\b"),
    ("gpl-2.0", "gplv2", r"\bgplv2\+?\b"),
    ("gpl-3.0", "gpl-3.0", r"gnu\.org/licenses/gpl-3\.0(?:\.\w{1,9})?"),
    ("gpl-2.0", "gpl-2.0", r"gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0(?:\.\w{1,9})?"),
    ("lgpl-3.0", "lesser general public license", r"\bgnu lesser general public license,? (?:version|v\.?) ?3\b"),
    ("lgpl-2.1", "lesser general public license", r"\bgnu lesser general public license,? (?:version|v\.?) ?2\.1\b"),
    ("lgpl-2.0", "library general public license", r"\bgnu library general public license\b"),
    ("lgpl-3.0", "lgplv3", r"\blgplv3\+?\b"),
    ("lgpl-2.1", "lgplv2", r"\blgplv2(?:\.1)?\+?\b"),
    ("agpl-3.0", "affero general public license", r"\bgnu affero general public license(?:,? (?:version|v\.?) ?3)?\b"),
    ("agpl-3.0", "agplv3", r"\bagplv3\+?\b"),
    ("gfdl-1.3", "free documentation license", r"\bgnu free documentation license,? version 1\.3\b"),
    ("gfdl-1.2", "free documentation license", r"\bgnu free documentation license,? version 1\.2\b"),
    ("gfdl", "free documentation license", r"\bfree documentation license\b"),
    ("bsd-2-clause", "2-clause", r"\b(?:simplified )?(?:bsd 2-clause|2-clause bsd)(?: license)?\b"),
    ("bsd-2-clause", "simplified bsd", r"\bsimplified bsd license\b"),
    ("bsd-2-clause", "freebsd license", r"\bfreebsd license\b"),
    ("bsd-3-clause", "3-clause", r"\b(?:bsd 3-clause|3-clause bsd)(?: license)?\b"),
    ("bsd-3-clause", "bsd license", r"\b(?:new|modified|revised) bsd license\b"),
    ("bsd-4-clause", "4-clause", r"\b(?:bsd 4-clause|4-clause bsd)(?: license)?\b"),
    ("bsd-4-clause", "original bsd", r"\boriginal bsd license\b"),
    ("mpl-2.0", "mozilla public license", r"\bmozilla public license,? (?:version|v\.?)? ?2(?:\.0)?\b"),
    ("mpl-1.1", "mozilla public license", r"\bmozilla public license,? (?:version|v\.?)? ?1\.1\b"),
    ("mpl-1.0", "mozilla public license", r"\bmozilla public license,? (?:version|v\.?)? ?1\.0\b"),
    ("mpl-2.0", "mozilla.org/mpl/2.0", r"mozilla\.org/mpl/2\.0"),
    ("epl-2.0", "eclipse public license", r"\beclipse public license ?,? ?-? ?(?:version|v\.?)? ?2\.0\b"),
    ("epl-1.0", "eclipse public license", r"\beclipse public license ?,? ?-? ?(?:version|v\.?)? ?1\.0\b"),
    ("edl-1.0", "eclipse distribution license", r"\beclipse distribution license\b"),
    ("cddl-1.0", "common development and distribution license", r"\bcommon development and distribution license\b"),
    ("cpl-1.0", "common public license", r"\bcommon public license\b"),
    ("ipl-1.0", "ibm public license", r"\bibm public license\b"),
    ("cpal-1.0", "common public attribution license", r"\bcommon public attribution license\b"),
    ("bsl-1.0", "boost software license", r"\bboost software license\b"),
    ("busl-1.1", "business source license", r"\bbusiness source license\b"),
    ("sspl-1.0", "server side public license", r"\bserver side public license\b"),
    ("elastic-2.0", "elastic license", r"\belastic license(?: 2\.0)?\b"),
    ("commons-clause", "commons clause", r"\bcommons clause license\b"),
    ("isc", "isc license", r"\bisc license\b"),
    ("zlib", "zlib", r"\bzlib(?:/libpng)? license\b"),
    ("libpng", "libpng license", r"\blibpng license\b"),
    ("unlicense", "unlicense", r"\b(?:the unlicense\b|unlicense\.org)"),
    ("wtfpl", "do what the fuck", r"\bdo what the fuck you want to public license\b"),
    ("beerware", "ware license", r"\bbeer-?ware license\b"),
    ("artistic-2.0", "artistic license", r"\bartistic license,? (?:version )?2(?:\.0)?\b"),
    ("artistic-1.0", "artistic license", r"\b(?:perl )?artistic license(?:,? (?:version )?1(?:\.0)?)?\b"),
    ("psf-2.0", "python software foundation license", r"\bpython software foundation license\b"),
    ("php-3.01", "php license", r"\bphp license\b"),
    ("ruby", "ruby license", r"\bruby license\b"),
    ("ofl-1.1", "open font license", r"\bsil open font license\b"),
    ("eupl-1.2", "european union public license", r"\beuropean union public license,? ?(?:version|v\.?)? ?1\.2\b"),
    ("eupl", "european union public license", r"\beuropean union public license\b"),
    ("ms-pl", "microsoft public license", r"\bmicrosoft public license\b"),
    ("ms-rl", "microsoft reciprocal license", r"\bmicrosoft reciprocal license\b"),
    ("afl-3.0", "academic free license", r"\bacademic free license\b"),
    ("osl-3.0", "open software license", r"\bopen software license\b"),
    ("qpl-1.0", "q public license", r"\bq public license\b"),
    ("sissl", "sun industry standards source license", r"\bsun industry standards source license\b"),
    ("ncsa", "ncsa open source license", r"\b(?:university of illinois/)?ncsa open source license\b"),
    ("zpl-2.1", "zope public license", r"\bzope public license\b"),
    ("json", "json license", r"\bjson license\b"),
    ("vim", "vim license", r"\bvim license\b"),
    ("openssl", "openssl license", r"\bopenssl license\b"),
    ("curl", "curl license", r"\bcurl license\b"),
    ("icu", "icu license", r"\bicu license\b"),
    ("unicode", "unicode license", r"\bunicode license(?: agreement)?\b"),
    ("w3c", "w3c software", r"\bw3c software (?:notice and )?license\b"),
    ("ftl", "freetype", r"\bfreetype (?:project )?license\b"),
    ("postgresql", "postgresql license", r"\bpostgresql license\b"),
    ("intel", "intel open source license", r"\bintel open source license\b"),
    ("odbl-1.0", "open database license", r"\bopen database license\b"),
    ("odc-by-1.0", "open data commons attribution license", r"\bopen data commons attribution license\b"),
    ("pddl-1.0", "public domain dedication and license", r"\bpublic domain dedication and license\b"),
    ("apsl", "apple public source license", r"\bapple public source license\b"),
    ("npl-1.1", "netscape public license", r"\bnetscape public license\b"),
    ("rpl-1.5", "reciprocal public license", r"\breciprocal public license\b"),
    ("upl-1.0", "universal permissive license", r"\buniversal permissive license\b"),
    ("lppl-1.3c", "latex project public license", r"\blatex project public license\b"),
    ("mulanpsl-2.0", "mulan permissive software license", r"\bmulan permissive software license\b"),
    ("cecill", "cecill", r"\bcecill(?:-[bc])? (?:free software )?license\b"),
    ("cc0-1.0", "publicdomain/zero", r"creativecommons\.org/publicdomain/zero/1\.0"),
    ("cc0-1.0", "cc0", r"\bcc0 (?:1\.0 )?(?:universal|license|public domain)\b"),
    ("cc-by-nc-sa", "by-nc-sa", r"creativecommons\.org/licenses/by-nc-sa/\d\.\d"),
    ("cc-by-nc-nd", "by-nc-nd", r"creativecommons\.org/licenses/by-nc-nd/\d\.\d"),
    ("cc-by-sa", "licenses/by-sa", r"creativecommons\.org/licenses/by-sa/\d\.\d"),
    ("cc-by-nc", "licenses/by-nc/", r"creativecommons\.org/licenses/by-nc/\d\.\d"),
    ("cc-by-nd", "licenses/by-nd", r"creativecommons\.org/licenses/by-nd/\d\.\d"),
    ("cc-by", "licenses/by/", r"creativecommons\.org/licenses/by/\d\.\d"),
    ("cc-by-sa", "attribution-sharealike", r"\bcreative commons attribution-sharealike(?: \d\.\d)?\b"),
    ("cc-by-nc", "attribution-noncommercial", r"\bcreative commons attribution-noncommercial(?: \d\.\d)?\b"),
    ("cc-by-nd", "attribution-noderiv", r"\bcreative commons attribution-noderiv(?:s|atives)(?: \d\.\d)?\b"),
    ("cc-by", "creative commons attribution", r"\bcreative commons attribution(?: \d\.\d)?\b"),
]

#: Further names, of which every word counts. (label, keyword, expression).
OTHER_NAMES = [
    ("0bsd", "zero-clause bsd", r"\bzero-clause bsd(?: license)?\b"),
    ("0bsd", "bsd zero clause license", r"\bbsd zero clause license\b"),
    ("mit-0", "mit no attribution", r"\bmit no attribution(?: license)?\b"),
    ("apache-2.0", "apache-2.0", r"\bapache-2\.0\b"),
    ("apache-2.0", "apache 2.0", r"\bapache 2\.0(?: license)?\b"),
    ("gpl-2.0", "gpl v2", r"\b(?:gnu )?gpl v2\b"),
    ("gpl-3.0", "gpl v3", r"\b(?:gnu )?gpl v3\b"),
    ("lgpl-2.1", "lgpl v2.1", r"\b(?:gnu )?lgpl v2\.1\b"),
    ("lgpl-3.0", "lgpl v3", r"\b(?:gnu )?lgpl v3\b"),
    ("agpl-3.0", "agpl v3", r"\b(?:gnu )?agpl v3\b"),
    ("aal", "attribution assurance license", r"\battribution assurance licenses?\b"),
    ("adobe", "adobe source code license", r"\badobe source code license(?: agreement)?\b"),
    ("aladdin", "aladdin free public license", r"\baladdin free public license\b"),
    ("anti-996", "996 license", r"\banti[- ]996 license\b"),
    ("anti-capitalist", "anti-capitalist software license", r"\banti-capitalist software license\b"),
    ("bittorrent", "bittorrent open source license", r"\bbittorrent open source license\b"),
    ("blueoak-1.0.0", "blue oak model license", r"\bblue oak model license(?: 1\.0\.0)?\b"),
    ("bsd-1-clause", "1-clause", r"\b(?:bsd 1-clause|1-clause bsd)(?: license)?\b"),
    ("bsd-3-clause-clear", "clear bsd", r"\bclear bsd license\b"),
    ("bsd-protection", "bsd protection license", r"\bbsd protection license\b"),
    ("bzip2", "bzip2", r"\bbzip2 (?:and libbzip2 )?license\b"),
    ("caldera", "caldera license", r"\bcaldera license\b"),
    ("cc0-1.0", "creative commons zero", r"\bcreative commons zero(?: v?1\.0)?(?: universal)? license\b"),
    ("cdla", "community data license agreement", r"\bcommunity data license agreement\b"),
    ("clartistic", "clarified artistic license", r"\bclarified artistic license\b"),
    ("cnri-python", "cnri python license", r"\bcnri python license(?: agreement)?\b"),
    ("condor", "condor public license", r"\bcondor public license\b"),
    ("confluent", "confluent community license", r"\bconfluent community license(?: agreement)?\b"),
    ("cua-opl-1.0", "cua office public license", r"\bcua office public license\b"),
    ("dsl", "design science license", r"\bdesign science license\b"),
    ("ecl-2.0", "educational community license", r"\beducational community license\b"),
    ("efl-2.0", "eiffel forum license", r"\beiffel forum license\b"),
    ("entessa", "entessa public license", r"\bentessa public license\b"),
    ("erlang", "erlang public license", r"\berlang public license\b"),
    ("eudatagrid", "datagrid software license", r"\beu datagrid software license\b"),
    ("fair", "fair license", r"\bthe fair license\b"),
    ("frameworx", "frameworx open license", r"\bframeworx open license\b"),
    ("free-art", "free art license", r"\bfree art license\b"),
    ("fsfap", "all-permissive license", r"\bgnu all-permissive license\b"),
    ("fsl", "functional source license", r"\bfunctional source license\b"),
    ("giftware", "giftware license", r"\bgiftware license\b"),
    ("glide", "3dfx glide", r"\b3dfx glide(?: source code general)? public license\b"),
    ("gust", "gust font", r"\bgust font (?:source )?license\b"),
    ("hippocratic", "hippocratic license", r"\bhippocratic license\b"),
    ("hpnd", "historical permission notice", r"\bhistorical permission notice and disclaimer\b"),
    ("ijg", "independent jpeg group license", r"\bindependent jpeg group license\b"),
    ("imagemagick", "imagemagick license", r"\bimagemagick license\b"),
    ("info-zip", "info-zip license", r"\binfo-zip license\b"),
    ("interbase", "interbase public license", r"\binterbase public license\b"),
    ("jabber", "jabber open source license", r"\bjabber open source license\b"),
    ("jasper", "jasper license", r"\bjasper license\b"),
    ("latex2e", "latex2e license", r"\blatex2e license\b"),
    ("leptonica", "leptonica license", r"\bleptonica license\b"),
    ("libtiff", "libtiff license", r"\blibtiff license\b"),
    ("liliq", "quebec free and open-source license", r"\bquebec free and open-source license\b"),
    ("llama", "community license", r"\bllama \d(?:\.\d)? community license(?: agreement)?\b"),
    ("lpl-1.02", "lucent public license", r"\blucent public license\b"),
    ("miros", "miros license", r"\bmiros license\b"),
    ("motosoto", "motosoto open source license", r"\bmotosoto open source license\b"),
    ("mpich2", "mpich2 license", r"\bmpich2 license\b"),
    ("mulan-public", "mulan public license", r"\bmulan public license\b"),
    ("multics", "multics license", r"\bmultics license\b"),
    ("naumen", "naumen public license", r"\bnaumen public license\b"),
    ("net-snmp", "net-snmp license", r"\bnet-snmp license\b"),
    ("nethack", "nethack general public license", r"\bnethack general public license\b"),
    ("nokia", "nokia open source license", r"\bnokia open source license\b"),
    ("nosl", "netizen open source license", r"\bnetizen open source license\b"),
    ("nposl-3.0", "non-profit open software license", r"\bnon-profit open software license\b"),
    ("ntp", "ntp license", r"\bntp license\b"),
    ("oclc-2.0", "oclc research public license", r"\boclc research public license\b"),
    ("ogl", "open government license", r"\bopen government license(?: v\d\.0)?\b"),
    ("ogtsl", "open group test suite license", r"\bopen group test suite license\b"),
    ("oldap", "openldap public license", r"\bopenldap public license\b"),
    ("open-publication", "open publication license", r"\bopen publication license\b"),
    ("openrail", "openrail", r"\b(?:bigscience |creativeml )?openrail(?:[-+]{1,2}m)? license\b"),
    ("parity", "parity public license", r"\bparity public license\b"),
    ("polyform-noncommercial", "polyform noncommercial license", r"\bpolyform noncommercial license\b"),
    ("polyform-shield", "polyform shield license", r"\bpolyform shield license\b"),
    ("polyform-small-business", "polyform small business license", r"\bpolyform small business license\b"),
    ("prosperity", "prosperity public license", r"\bprosperity public license\b"),
    ("qhull", "qhull license", r"\bqhull license\b"),
    ("redis", "redis source available license", r"\bredis source available license\b"),
    ("rpsl-1.0", "realnetworks public source license", r"\brealnetworks public source license\b"),
    ("ricoh", "ricoh source code public license", r"\bricoh source code public license\b"),
    ("rsa-md", "message-digest license", r"\brsa message-digest license\b"),
    ("sendmail", "sendmail license", r"\bsendmail license\b"),
    ("sgi-b", "sgi free software license b", r"\bsgi free software license b\b"),
    ("simpl-2.0", "simple public license", r"\bsimple public license\b"),
    ("sleepycat", "sleepycat license", r"\bsleepycat license\b"),
    ("smail", "smail general public license", r"\bsmail general public license\b"),
    ("smlnj", "standard ml of new jersey license", r"\bstandard ml of new jersey license\b"),
    ("spencer", "spencer license", r"\b(?:henry )?spencer license\b"),
    ("spl-1.0", "sun public license", r"\bsun public license\b"),
    ("sugarcrm", "sugarcrm public license", r"\bsugarcrm public license\b"),
    ("swig", "swig license", r"\bswig license\b"),
    ("tcl", "tcl/tk license", r"\btcl/tk license\b"),
    ("timescale", "timescale license", r"\btimescale license\b"),
    ("tmate", "tmate open source license", r"\btmate open source license\b"),
    ("ubuntu-font", "ubuntu font license", r"\bubuntu font license\b"),
    ("vsl-1.0", "vovida software license", r"\bvovida software license\b"),
    ("watcom-1.0", "open watcom public license", r"\b(?:sybase )?open watcom public license\b"),
    ("wxwindows", "wxwindows library license", r"\bwxwindows library license\b"),
    ("xfree86", "xfree86 license", r"\bxfree86 license\b"),
    ("xinetd", "xinetd license", r"\bxinetd license\b"),
    ("xnet", "x.net", r"\bx\.net license\b"),
    ("yahoo", "yahoo! public license", r"\byahoo! public license\b"),
    ("zend", "zend license", r"\bzend license\b"),
    ("zimbra", "zimbra public license", r"\bzimbra public license\b"),
]

#: The same for wording of the licenses themselves.
TEXTS = [
    ("mit", "permission is hereby granted", r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use", r"permission to use, copy, modify, and(?:/or)? distribute this software for any purpose"),
    ("apache-2.0", "licensed under the apache license", r"licensed under the apache license, version 2\.0 \(the \W?license\W?\)"),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms, with or without modification"),
    ("bsd-3-clause", "neither the name", r"neither the name of .{1,80}? nor the names of its contributors"),
    ("bsd-4-clause", "all advertising materials", r"all advertising materials mentioning features or use of this software"),
    ("zlib", "altered source versions", r"altered source versions must be plainly marked as such"),
    ("gpl", "it under the terms of the gnu general public license", r"redistribute it and/or modify it under the terms of the gnu general public license"),
    ("lgpl", "it under the terms of the gnu lesser general public license", r"redistribute it and/or modify it under the terms of the gnu lesser general public license"),
    ("agpl-3.0", "it under the terms of the gnu affero general public license", r"redistribute it and/or modify it under the terms of the gnu affero general public license"),
    ("mpl-2.0", "subject to the terms of the mozilla public", r"subject to the terms of the mozilla public license, v\. 2\.0"),
    ("unlicense", "released into the public domain", r"this is free and unencumbered software released into the public domain"),
    ("beerware", "as long as you retain this notice", r"as long as you retain this notice you can do whatever you want"),
    ("json", "for good, not evil", r"the software shall be used for good, not evil"),
    ("bsl-1.0", "person or organization obtaining a copy", r"any person or organization obtaining a copy of the software and accompanying documentation"),
    ("ofl-1.1", "may be sold by itself", r"neither the font software nor any of its individual components,.{0,60}may be sold by itself"),
    ("cc0-1.0", "waived all copyright", r"has waived all copyright and related or neighboring rights"),
]

#: The same for families and general notices.
GENERAL = [
    ("apache", "apache license", r"\bapache license\b"),
    ("gpl", "general public license", r"\bgeneral public license\b"),
    ("lgpl", "lesser general public license", r"\blesser general public license\b"),
    ("bsd", "bsd license", r"\bbsd license\b"),
    ("mpl", "mozilla public license", r"\bmozilla public license\b"),
    ("epl", "eclipse public license", r"\beclipse public license\b"),
    ("creative-commons", "creative commons license", r"\bcreative commons license\b"),
    ("public-domain", "public domain", r"\b(?:placed|dedicated|released|is) (?:in|into|to) the public domain\b"),
    ("all-rights-reserved", "all rights reserved", r"\ball rights reserved\b"),
    ("proprietary", "proprietary", r"\bproprietary (?:and confidential|license)\b"),
    ("commercial", "commercial license", r"\bcommercial license\b"),
    ("copyright", "copyright", r"\bcopyright (?:\(c\) |© )?(?:19|20)\d\d\b"),
]

RULES: list[Rule] = [
    *(Rule(x, 3, "spdx-license-identifier", rf"spdx-license-identifier: ?\(?{re.escape(x)}(?![\w.+-])") for x in SPDX_IDS),
    *(Rule(a, 3, k, p) for a, k, p in TEXTS),
    *(Rule(a, 2, k, p) for a, k, p in NAMES + OTHER_NAMES),
    *(Rule(a, 1, k, p) for a, k, p in GENERAL),
]

#: Single words, or parts of words, of which every match of a rule contains one: what a text must hold to be looked at. They
#: hold no blank, as they are searched before white space is made single blanks.
STEMS = ["licen", "copyright", "public", "permi", "redistrib", "spdx", "gpl", "clause", "bsd", "cc0", "by-nc", "attribution", "apache", "expat", "advertising", "contributors", "plainly", "retain", "evil", "components,", "accompanying", "reserved", "proprietary", "cecill", "freetype", "w3c", "mozilla", "cddl", "waived"]
