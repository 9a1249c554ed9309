"""Hand-written signatures of license notices and clauses.

They match a text's words in ASCII lower case, joined by one blank: no
punctuation, "author's" being "author s". Each: label, keyword (in all that
the expression matches), priority, weight, expression.
"""

from __future__ import annotations

NOTICES = (
    # MIT and its kin
    ("mit", "permission is hereby granted", 90, 1.0, r"permission is hereby granted free of charge to any person obtaining a copy(?: of this software and associated documentation files)?"),
    ("mit", "the above copyright notice", 60, 0.8, r"the above copyright notice and this permission notice shall be included in all copies or substantial portions"),
    ("mit", "deal in the software", 75, 0.9, r"to deal in the software without restriction including without limitation the rights"),
    ("mit", "use copy modify merge publish", 75, 0.9, r"rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit", "opensource org licenses mit", 80, 0.95, r"(?:www )?opensource org licenses mit(?: license)?(?: php)?"),
    ("mit", "mit licensed", 60, 0.9, r"mit licensed"),
    ("mit", "mit style", 45, 0.7, r"mit style licen[sc]e"),
    ("mit", "x consortium", 70, 0.9, r"in no event shall the x consortium be liable"),
    ("mit", "dual licensed under the mit", 70, 0.9, r"dual licensed under the mit (?:and|or) (?:gpl|apache|bsd)(?: 2 0)?(?: licenses)?"),
    ("mit-0", "mit no attribution", 75, 0.95, r"mit no attribution"),
    ("curl", "copyright c 1996", 70, 0.8, r"copyright c 1996 (?:20\d\d )?daniel stenberg"),
    ("ntp", "with or without fee is hereby granted", 80, 0.9, r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", "without fee is hereby granted provided", 85, 0.9, r"for any purpose and without fee is hereby granted provided that the above copyright notice appear in all copies"),
    ("smlnj", "standard ml of new jersey", 70, 0.9, r"standard ml of new jersey copyright notice licen[sc]e and disclaimer"),
    # BSD
    ("bsd", "redistribution and use", 90, 1.0, r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions of source code must", 75, 0.9, r"redistributions of source code must retain the (?:above )?copyright notice"),
    ("bsd", "redistributions in binary form must", 75, 0.9, r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd", "may be used to endorse or promote", 70, 0.85, r"(?:names?|contributors) may be used to endorse or promote products derived from this software|names? of (?:its|the) contributors may be used to endorse or promote products"),
    ("bsd", "all advertising materials mentioning", 80, 0.95, r"all advertising materials mentioning features or use of this software must display"),
    ("bsd", "regents of the university of california", 60, 0.8, r"the regents of the university of california"),
    ("bsd", "bsd style", 45, 0.7, r"bsd style licen[sc]e"),
    ("bsd", "bsd licensed", 60, 0.9, r"bsd licensed"),
    ("bsd", "opensource org licenses bsd", 80, 0.95, r"opensource org licenses bsd(?: license| [23] clause)?(?: php)?"),
    ("bsd", "no express or implied licenses to any party", 75, 0.9, r"no express or implied licenses to any party s patent rights are granted"),
    ("freebsd", "freebsd project", 55, 0.7, r"(?:representing official policies either expressed or implied )?of the freebsd project"),
    # ISC
    ("isc", "permission to use copy modify", 90, 1.0, r"permission to use copy modify and or distribute this software for any purpose with or without fee"),
    ("isc", "isc licensed", 60, 0.9, r"isc licensed"),
    ("isc", "the software is provided as is and isc disclaims", 85, 1.0, r"the software is provided as is and isc disclaims all warranties"),
    ("isc", "author disclaims all warranties", 65, 0.8, r"(?:the )?author disclaims all warranties with regard to this software"),
    # Apache
    ("apache", "you may not use this file", 90, 1.0, r"you may not use this file except in compliance with the license"),
    ("apache", "licensed to the apache software foundation", 85, 1.0, r"licensed to the apache software foundation(?: asf)? under one or more contributor license agreements"),
    ("apache", "www apache org licenses", 85, 1.0, r"www apache org licenses(?: license 2 0)?"),
    ("apache", "apache licensed", 60, 0.9, r"apache licensed"),
    ("apache", "this product includes software developed by the apache", 75, 0.9, r"this product includes software developed by the apache (?:group|software foundation)"),
    ("apache", "grant of patent license", 45, 0.6, r"grant of patent license subject to the terms and conditions of this license"),
    ("apache", "unless required by applicable law or agreed to in writing", 60, 0.85, r"unless required by applicable law or agreed to in writing software distributed under the license"),
    ("apache", "derived from this software without prior written permission for written permission please contact apache", 80, 0.95, r"derived from this software without prior written permission for written permission please contact apache"),
    ("ecl", "educational community license", 75, 0.95, r"educational community license(?: version)?(?: [12] 0)?"),
    # GNU
    ("gpl", "free software you can redistribute", 80, 0.9, r"is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "free software you can redistribute", 85, 0.9, r"is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("agpl", "free software you can redistribute", 85, 0.9, r"is free software you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "you should have received a copy of the gnu general", 80, 0.95, r"you should have received a copy of the gnu general public license"),
    ("lgpl", "you should have received a copy of the gnu l", 82, 0.95, r"you should have received a copy of the gnu (?:lesser|library) general public license"),
    ("agpl", "you should have received a copy of the gnu affero", 82, 0.95, r"you should have received a copy of the gnu affero general public license"),
    ("gpl", "www gnu org licenses gpl", 80, 0.95, r"www gnu org licenses gpl(?: [123] 0)?(?: html| txt)?"),
    ("lgpl", "www gnu org licenses lgpl", 80, 0.95, r"www gnu org licenses lgpl(?: [23] [01])?(?: html| txt)?"),
    ("agpl", "www gnu org licenses agpl", 80, 0.95, r"www gnu org licenses agpl(?: 3 0)?(?: html| txt)?"),
    ("gfdl", "gnu free documentation license", 80, 0.95, r"gnu free documentation license(?: version)?(?: 1 [123])?"),
    ("gfdl", "with no invariant sections", 75, 0.9, r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", "www gnu org licenses fdl", 80, 0.95, r"www gnu org licenses fdl(?: html)?"),
    ("gpl", "gpl compatible", 30, 0.4, r"gpl compatible"),
    ("gpl", "gplv2 or later", 60, 0.9, r"gplv2 or later"),
    ("gpl", "gplv3 or later", 60, 0.9, r"gplv3 or later"),
    ("gpl", "gpl licensed", 60, 0.9, r"gpl licensed"),
    ("lgpl", "lgplv", 60, 0.9, r"lgplv(?:2|2 1|3)(?: or later)?"),
    ("gpl", "either version", 50, 0.6, r"either version [123](?: of the license)? or at your option any later version"),
    ("gpl", "free software foundation inc 51 franklin", 50, 0.7, r"free software foundation inc 51 franklin (?:street|st)"),
    ("gpl", "free software foundation inc 59 temple place", 50, 0.7, r"free software foundation inc 59 temple place"),
    ("gpl", "this program is distributed in the hope", 60, 0.8, r"this program is distributed in the hope that it will be useful but without any warranty"),
    ("lgpl", "this library is distributed in the hope", 60, 0.8, r"this library is distributed in the hope that it will be useful but without any warranty"),
    ("gpl", "everyone is permitted to copy and distribute verbatim", 70, 0.9, r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl-classpath", "classpath exception", 75, 0.9, r"(?:with (?:the )?)?classpath exception"),
    ("gpl-classpath", "linking this library statically", 75, 0.9, r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-gcc", "gcc runtime library exception", 75, 0.9, r"gcc runtime library exception"),
    ("gpl-font", "font exception", 60, 0.8, r"gpl font exception|(?:with )?font exception"),
    ("agpl", "affero general public", 45, 0.8, r"affero general public license(?: version)?(?: v?[13])?"),
    ("agpl", "remote network interaction", 55, 0.7, r"remote network interaction use with the gnu general public license"),
    # Mozilla, Eclipse and other weak copyleft
    ("mpl", "source code form is subject", 90, 1.0, r"this source code form is subject to the terms of the mozilla public license"),
    ("mpl", "mozilla org mpl", 80, 0.95, r"(?:www )?mozilla org mpl(?: [12] [01])?"),
    ("mpl", "the contents of this file are subject to the mozilla", 85, 0.95, r"the contents of this file are subject to the mozilla public license"),
    ("mpl", "mozilla tri license", 70, 0.9, r"mozilla tri license"),
    ("npl", "netscape public license", 75, 0.95, r"netscape public license(?: version)?(?: 1 [01])?"),
    ("epl", "this program and the accompanying materials", 85, 0.95, r"this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("epl", "www eclipse org legal epl", 80, 0.95, r"www eclipse org legal epl(?: v10| 2 0| v20)?(?: html)?"),
    ("edl", "eclipse distribution license", 75, 0.95, r"eclipse distribution license(?: v)?(?: 1 0)?"),
    ("cpl", "common public license", 75, 0.95, r"common public license(?: version| v)?(?: [01] [05])?"),
    ("ipl", "ibm public license", 75, 0.95, r"ibm public license(?: version)?(?: 1 0)?"),
    ("cddl", "the contents of this file are subject to the terms of the common development", 85, 0.95, r"the contents of this file are subject to the terms of the common development and distribution license"),
    ("cddl", "opensource org licenses cddl", 80, 0.95, r"opensource org licenses cddl1?(?: 1 0)?(?: php| txt)?"),
    ("spl", "sun public license", 75, 0.95, r"sun public license(?: version)?(?: 1 0)?"),
    ("sissl", "sun industry standards source license", 75, 0.95, r"sun industry standards source license"),
    ("cpal", "common public attribution license", 75, 0.95, r"common public attribution license(?: version)?(?: 1 0)?"),
    ("osl", "open software license", 70, 0.9, r"open software license(?: version| v)?(?: [123] [01])?"),
    ("afl", "academic free license", 75, 0.95, r"academic free license(?: version| v)?(?: [123] [012])?"),
    ("rpl", "reciprocal public license", 75, 0.95, r"reciprocal public license(?: version)?(?: 1 [15])?"),
    ("ms-rl", "microsoft reciprocal license", 75, 0.95, r"microsoft reciprocal license"),
    ("ms-pl", "microsoft permissive license", 75, 0.9, r"microsoft permissive license"),
    ("ms-lpl", "microsoft limited public license", 75, 0.95, r"microsoft limited public license"),
    ("apsl", "apple public source license", 75, 0.95, r"apple public source license(?: version)?(?: [12] [012])?"),
    ("qpl", "q public license", 70, 0.9, r"(?:the )?q public license(?: version)?(?: 1 0)?"),
    ("nosa", "nasa open source agreement", 75, 0.95, r"nasa open source agreement(?: version)?(?: 1 [13])?"),
    ("nokia", "nokia open source license", 75, 0.95, r"nokia open source license"),
    ("sleepycat", "sleepycat", 70, 0.9, r"sleepycat (?:public |software )?(?:license|inc|software)"),
    ("eupl", "licensed under the eupl", 80, 0.95, r"licensed under the eupl(?: version)?(?: v?1 [012])?"),
    ("cecill", "cecill", 75, 0.95, r"cecill(?: [abc])?(?: licen[sc]e| version)?(?: [12](?: [01])?)?"),
    ("cecill", "french law on the distribution of free software", 75, 0.95, r"(?:abiding by the rules of |under )?french law on the distribution of free software"),
    ("liliq", "licence libre du qu", 70, 0.9, r"licence libre du qu(?:é|e)bec"),
    ("oclc", "oclc research public license", 75, 0.95, r"oclc research public license(?: 2 0)?"),
    ("lpl", "lucent public license", 75, 0.95, r"lucent public license(?: version)?(?: 1 0[02]?)?"),
    ("lppl", "latex project public license", 80, 0.95, r"(?:the )?latex project public license(?: version)?(?: 1 [0123][abc]?)?"),
    ("lppl", "lppl maintenance status", 75, 0.9, r"this work has the lppl maintenance status"),
    ("motosoto", "motosoto open source license", 75, 0.95, r"motosoto open source license"),
    ("ngpl", "nethack general public license", 80, 0.95, r"nethack general public license"),
    ("frameworx", "frameworx open license", 75, 0.95, r"frameworx open license"),
    ("rscpl", "ricoh source code public license", 75, 0.95, r"ricoh source code public license"),
    ("simpl", "simple public license", 70, 0.9, r"simple public license(?: 2 0)?"),
    ("vsl", "vovida software license", 75, 0.95, r"vovida software license(?: v 1 0)?"),
    ("watcom", "sybase open watcom public license", 80, 0.95, r"sybase open watcom public license"),
    ("sgi-b", "sgi free software license b", 80, 0.95, r"sgi free software license b(?: version)?(?: 2 0)?"),
    ("xnet", "x net license", 70, 0.9, r"(?:the )?x net license"),
    ("zpl", "zope public license", 75, 0.95, r"zope public license(?: zpl)?(?: version)?(?: [12] [01])?"),
    ("w3c", "w3c software notice and license", 80, 0.95, r"w3c software notice and license"),
    ("w3c", "w3c software and document", 75, 0.95, r"w3c software and document (?:notice and )?license"),
    ("w3c", "w3c document license", 75, 0.95, r"w3c document license"),
    ("ncsa", "university of illinois ncsa open source license", 85, 1.0, r"university of illinois ncsa open source license"),
    ("ncsa", "ncsa open source license", 75, 0.95, r"ncsa open source license"),
    ("llvm", "llvm exceptions", 75, 0.95, r"(?:apache license v2 0 )?with llvm exceptions"),
    ("naumen", "naumen public license", 75, 0.95, r"naumen public license"),
    ("entessa", "entessa public license", 75, 0.95, r"entessa public license"),
    ("eudatagrid", "eu datagrid software license", 75, 0.95, r"eu datagrid software license"),
    ("fair", "usage of the works is permitted", 80, 0.95, r"usage of the works is permitted provided that this instrument is retained"),
    ("multics", "multics license", 70, 0.9, r"multics license"),
    ("mirros", "miros licen", 70, 0.9, r"(?:the )?miros licen[sc]e"),
    ("mulanpsl", "mulan psl", 80, 0.95, r"(?:licensed under )?mulan psl v[12]"),
    ("mulanpsl", "mulan permissive software license", 80, 0.95, r"mulan permissive software license"),
    ("openldap", "openldap public license", 80, 0.95, r"openldap public license(?: version)?(?: 2 [78])?"),
    ("openssl", "developed by the openssl project", 80, 0.95, r"this product includes software developed by the openssl project"),
    ("openssl", "openssl license", 70, 0.9, r"openssl license"),
    ("ssleay", "cryptographic software written by eric young", 80, 0.95, r"this product includes cryptographic software written by eric young"),
    ("php", "this product includes php software", 80, 0.95, r"this product includes php software"),
    ("php", "www php net license", 80, 0.95, r"www php net license(?: 3 0[01]?)?(?: txt)?"),
    ("psf", "psf license agreement", 75, 0.95, r"psf license agreement(?: for python)?"),
    ("psf", "python software foundation license", 75, 0.95, r"python software foundation license(?: version)?(?: 2)?"),
    ("cnri", "cnri python license", 75, 0.95, r"cnri python license"),
    ("ruby", "same terms as ruby", 65, 0.85, r"(?:under the )?same terms as ruby(?: itself)?"),
    ("ruby", "ruby license", 60, 0.85, r"ruby license"),
    ("perl", "same terms as perl", 70, 0.9, r"(?:under the )?same terms as perl(?: 5)?(?: itself)?"),
    ("artistic", "this package is free software you can", 60, 0.6, r"this package is free software you can redistribute it and or modify it under the same terms"),
    ("artistic", "artistic license", 55, 0.85, r"(?:clarified |perl )?artistic license(?: [12] 0)?"),
    ("tcl", "tcl tk license", 70, 0.9, r"tcl tk license"),
    ("vim", "vim license", 65, 0.9, r"vim license"),
    ("zend", "zend engine license", 75, 0.95, r"zend engine license"),
    ("icu", "icu license", 70, 0.9, r"icu license"),
    ("unicode", "unicode data files", 65, 0.85, r"unicode data files and software"),
    ("unicode", "unicode license agreement", 75, 0.95, r"unicode license agreement"),
    ("libpng", "libpng license", 70, 0.9, r"libpng license"),
    ("libtiff", "sam leffler", 60, 0.8, r"copyright c 1988 1997 sam leffler"),
    ("ijg", "independent jpeg group", 65, 0.85, r"this software is based in part on the work of the independent jpeg group"),
    ("ftl", "freetype project license", 80, 0.95, r"(?:the )?freetype project license"),
    ("ftl", "portions of this software are copyright", 55, 0.7, r"portions of this software are copyright (?:c )?(?:19|20)\d\d the freetype project"),
    ("bzip2", "bzip2 license", 70, 0.9, r"bzip2 license"),
    ("info-zip", "info zip license", 75, 0.9, r"info zip license"),
    ("zlib", "altered source versions", 90, 1.0, r"altered source versions must be plainly marked as such"),
    ("zlib", "provided as is without any express or implied warranty in no event will the authors", 80, 0.95, r"this software is provided as is without any express or implied warranty in no event will the authors be held liable"),
    ("zlib", "the origin of this software must not be misrepresented", 85, 1.0, r"the origin of this software must not be misrepresented"),
    ("boost", "boost software license", 80, 0.9, r"distributed under the boost software license version 1 0"),
    ("boost", "boost org license", 80, 0.95, r"(?:www )?boost org license 1 0 txt"),
    ("boost", "machine executable object code generated", 80, 0.95, r"machine executable object code generated by a source language processor"),
    ("bsl", "business source license", 80, 0.95, r"business source license(?: version)?(?: 1 1)?"),
    ("sspl", "server side public license", 80, 0.95, r"server side public license(?: version)?(?: 1)?"),
    ("elastic", "elastic license", 75, 0.95, r"elastic license(?: 2 0| v2)?"),
    ("commons-clause", "commons clause", 70, 0.9, r"commons clause(?: license condition)?(?: v?1 0)?"),
    ("polyform", "polyform", 70, 0.9, r"polyform (?:noncommercial|small business|shield|perimeter|strict|internal use|free trial)(?: license)?(?: 1 0 0)?"),
    ("confluent", "confluent community license", 75, 0.95, r"confluent community license"),
    ("timescale", "timescale license", 70, 0.9, r"timescale license"),
    ("hippocratic", "hippocratic license", 75, 0.95, r"hippocratic license(?: version)?(?: [123] [01])?"),
    ("json", "used for good not evil", 85, 1.0, r"(?:the software )?shall be used for good not evil"),
    ("beerware", "beer ware license", 80, 0.95, r"(?:the )?beer ware license"),
    ("wtfpl", "do what the", 90, 1.0, r"do what the fuck you want to(?: public license)?"),
    ("wtfpl", "www wtfpl net", 80, 0.95, r"www wtfpl net"),
    ("unlicense", "free and unencumbered", 90, 1.0, r"this is free and unencumbered software released into the public domain"),
    ("unlicense", "unlicense org", 80, 0.95, r"(?:please refer to )?(?:http )?unlicense org"),
    ("0bsd", "zero clause bsd", 75, 0.95, r"zero clause bsd"),
    ("blueoak", "blue oak model license", 80, 0.95, r"blue oak model license(?: 1 0 0)?"),
    ("upl", "universal permissive license", 75, 0.95, r"universal permissive license(?: v)?(?: 1 0)?"),
    # public domain and Creative Commons
    ("public-domain", "public domain", 40, 0.7, r"(?:dedicated to|released into|placed in|in) the public domain"),
    ("public-domain", "no copyright is claimed", 50, 0.7, r"no copyright is claimed"),
    ("public-domain", "public domain dedication", 55, 0.85, r"public domain dedication(?: and license)?"),
    ("public-domain", "creativecommons org publicdomain mark", 80, 0.95, r"creativecommons org publicdomain mark(?: 1 0)?"),
    ("public-domain", "work of the united states government", 55, 0.7, r"work of the united states government"),
    ("pddl", "open data commons public domain", 80, 0.95, r"open data commons public domain dedication(?: and)? license"),
    ("cc0", "cc0", 60, 0.9, r"cc0(?: 1 0)?(?: universal)?"),
    ("cc0", "creativecommons org publicdomain zero", 85, 1.0, r"creativecommons org publicdomain zero(?: 1 0)?"),
    ("cc0", "waived all copyright and related", 80, 0.95, r"waived all copyright and related or neighboring rights"),
    ("cc-by", "creativecommons org licenses by", 78, 0.95, r"creativecommons org licenses by(?: [1234] [05])?"),
    ("cc-by-sa", "creativecommons org licenses by sa", 80, 0.95, r"creativecommons org licenses by sa(?: [1234] [05])?"),
    ("cc-by-nc", "creativecommons org licenses by nc", 80, 0.95, r"creativecommons org licenses by nc(?: [1234] [05])?"),
    ("cc-by-nd", "creativecommons org licenses by nd", 80, 0.95, r"creativecommons org licenses by nd(?: [1234] [05])?"),
    ("cc-by-nc-sa", "creativecommons org licenses by nc sa", 82, 0.95, r"creativecommons org licenses by nc sa(?: [1234] [05])?"),
    ("cc-by-nc-nd", "creativecommons org licenses by nc nd", 82, 0.95, r"creativecommons org licenses by nc nd(?: [1234] [05])?"),
    ("cc-by-nd", "attribution noderivs", 60, 0.85, r"attribution noderivs"),
    ("cc-by-nd", "attribution noderivatives", 60, 0.85, r"attribution noderivatives"),
    ("cc", "some rights reserved", 25, 0.4, r"some rights reserved"),
    ("cc", "under a creative commons", 35, 0.6, r"(?:licensed |available )?under a creative commons licen[sc]e"),
    ("cc-sampling", "sampling plus", 60, 0.8, r"(?:creative commons )?sampling plus 1 0"),
    # data, documents, fonts, art
    ("odbl", "opendatacommons org licenses odbl", 80, 0.95, r"opendatacommons org licenses odbl(?: 1 0)?"),
    ("odc-by", "open data commons attribution", 80, 0.95, r"open data commons attribution license"),
    ("odc-by", "opendatacommons org licenses by", 80, 0.95, r"opendatacommons org licenses by(?: 1 0)?"),
    ("ogl", "open government licen", 75, 0.95, r"open government licen[sc]e(?: version| v)?(?: ?[123] 0)?"),
    ("cdla", "community data license agreement", 80, 0.95, r"community data license agreement(?: permissive| sharing)?(?: (?:version )?[12] 0)?"),
    ("etalab", "licence ouverte", 70, 0.9, r"licence ouverte(?: open licence)?"),
    ("dl-de", "datenlizenz deutschland", 75, 0.95, r"datenlizenz deutschland(?: namensnennung| zero)?"),
    ("ofl", "sil open font license", 80, 0.95, r"sil open font license(?: version)?(?: 1 [01])?"),
    ("ofl", "scripts sil org ofl", 80, 0.95, r"scripts sil org ofl"),
    ("ubuntu-font", "ubuntu font licen", 75, 0.95, r"ubuntu font licen[sc]e(?: version)?(?: 1 0)?"),
    ("bitstream-vera", "bitstream vera", 70, 0.85, r"bitstream vera (?:fonts? copyright|is a trademark)"),
    ("arphic", "arphic public license", 80, 0.95, r"arphic public license"),
    ("lal", "free art license", 75, 0.95, r"free art license(?: 1 [23])?"),
    ("lal", "licence art libre", 75, 0.95, r"licence art libre"),
    ("opl", "open publication license", 75, 0.95, r"open publication license(?: v1 0)?"),
    ("opencontent", "open content license", 70, 0.9, r"open content license"),
    ("rail", "responsible ai license", 75, 0.9, r"(?:creativeml |bigscience )?(?:open )?responsible ai license"),
    ("rail", "openrail", 75, 0.9, r"(?:creativeml |bigscience |bigcode )?openrail(?: m| s)?"),
    # proprietary and general
    ("proprietary", "all rights reserved", 20, 0.4, r"all rights reserved"),
    ("proprietary", "confidential", 30, 0.5, r"(?:confidential and proprietary|proprietary and confidential)"),
    ("proprietary", "end user license agreement", 40, 0.6, r"end user license agreement"),
    ("proprietary", "unauthorized copying of this", 45, 0.7, r"unauthorized copying of this (?:file|software|document) via any medium is strictly prohibited"),
    ("proprietary", "may not be reproduced", 30, 0.5, r"may not be reproduced (?:distributed |stored )?(?:or transmitted )?in any form"),
    ("proprietary", "without the prior written permission of the publisher", 35, 0.5, r"without the prior written permission of the publisher"),
    ("proprietary", "trade secrets of", 35, 0.5, r"(?:contains|constitutes) (?:confidential information and )?trade secrets of"),
    ("proprietary", "for evaluation purposes only", 30, 0.5, r"for evaluation purposes only"),
    ("non-commercial", "for non commercial use only", 40, 0.6, r"for non commercial use only"),
    ("non-commercial", "commercial use is prohibited", 40, 0.6, r"commercial use is prohibited"),
    ("non-commercial", "for personal use only", 30, 0.4, r"for personal use only"),
    ("non-commercial", "research purposes only", 40, 0.6, r"for (?:academic )?research purposes only"),
    ("freeware", "freeware", 25, 0.4, r"(?:is|as) freeware"),
    ("shareware", "shareware", 25, 0.4, r"(?:is|as) shareware"),
    ("copyright", "copyright", 10, 0.3, r"copyright (?:c )?(?:19|20)\d\d"),
)
