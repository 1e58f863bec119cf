"""Openings of documents, each read and labelled by hand, on which probabilities are calibrated."""

HOLDOUT = [
    ("prosa", 'Working capital required funding of $1,690.1 million against 26.3% a year earlier, partly because warranty claims had no effect on cash at larger sites. Within the consumer unit, the board and our franchise partners together recorded a charge of $1,393.4 million, subject to the usual covenants and approvals.'),
    ("prosa", "Question: Using the filing for fiscal year 2017, state Yorzuralund Holdings's days payable outstanding.\nAnswer: Reflecting the new standard, the leasing subsidiary fell short by 23.328%, although promotional allowances had been underestimated ($2,355.73 million), although the comparison is affected by an extra week (schedule 8564)."),
    ("prosa", 'By the middle of the year, the joint venture and our distribution network together reclassified $352.4 million, and the related interest was capitalised. The leasing subsidiary settled claims worth $3.79 billion against $20.61 billion a year earlier, largely as labour costs turned out weaker despite tighter controls.'),
    ("prosa", 'Under the amended facility, selling expense committed 47,083 thousand dollars, partly because payments to vendors were settled before the deadline outside the core market, which management does not regard as lasting.'),
    ("prosa", 'The credit facility released a provision of $2,546.9 million against 58,611 thousand dollars a year earlier, although the licence terms came down faster than assumed under the old contract.\nAt the end of the period, the credit facility carried a balance of $2,258.7 million, partly because two supplier contracts moved into the next period despite tighter controls, and this trend continued after the closing date.'),
    ("prosa", 'Question: What drove the change in dividend payout ratio of Kesbovarusk\nHoldings in FY2019?\nAnswer: In contrast, the loyalty programme deferred 7.811%, while\nfreight rates stayed well above the plan under the old contract\n($2,321.37 million), and the remainder is due within five years (schedule\n3988).'),
    ("prosa", "La ligne de cr\xe9dit a nettement progress\xe9 au cours de l'exercice, comme l'expliquent les notes annexes. La ligne de cr\xe9dit sera pr\xe9sent\xe9e s\xe9par\xe9ment, si bien qu'aucune d\xe9pr\xe9ciation n'a \xe9t\xe9 constat\xe9e. La marge brute a \xe9t\xe9 examin\xe9e par les auditeurs, parce que les co\xfbts de transport sont rest\xe9s \xe9lev\xe9s. Le conseil est rest\xe9e conforme aux pr\xe9visions, comme l'expliquent les notes annexes."),
    ("prosa", 'Vergi kar\u015f\u0131l\u0131\u011f\u0131 bu d\xf6nemde beklenenden h\u0131zl\u0131 artt\u0131, b\xf6ylece \xf6l\xe7\xfct ilk kez sa\u011flanm\u0131\u015f oldu (2015: 262,9).\nKuzey fabrikas\u0131 y\xfczde olarak k\xfc\xe7\xfck ama anlaml\u0131 bir fark g\xf6sterdi, b\xf6ylece \xf6l\xe7\xfct ilk kez sa\u011flanm\u0131\u015f oldu. Vergi kar\u015f\u0131l\u0131\u011f\u0131 y\xfczde olarak k\xfc\xe7\xfck ama anlaml\u0131 bir fark g\xf6sterdi, b\xf6ylece \xf6l\xe7\xfct ilk kez sa\u011flanm\u0131\u015f oldu.'),
    ("prosa", 'Under the amended facility, our distribution network and the wholesale channel together exceeded the plan by 1.7%, and the remainder is due within five years. Reflecting the new standard, the audit committee and gross profit together reported an increase of $368.9 million, and no single item was material.'),
    ("prosa", 'Within the consumer unit, the clinical pipeline and working capital together contributed $19.87 billion, although the comparison is affected by an extra week. For the first half, the pension plan recorded a charge of $368.5 million, since travel demand ended without renewal during the spring, and the estimate may change as facts emerge.'),
    ("prosa", 'El fondo de comercio qued\xf3 por debajo del presupuesto, lo que refleja sobre todo el tipo de cambio  El canal mayorista fue revisado por los auditores, lo que refleja sobre todo el tipo de cambio (2022: 575,1)  El canal mayorista qued\xf3 por debajo del presupuesto, lo que refleja sobre todo el tipo de cambio  La red de distribuci\xf3n fue revisado por los auditores, debido a que los fletes siguieron altos  El fondo de come'),
    ("prosa", 'The audit committee was reduced by $277 million in fiscal 2018 against 12.8% a year earlier, mainly because the licence terms were renegotiated twice for the second time.\nUnder the amended facility, the bottling venture and the clinical pipeline together returned $1,531.7 million, which is shown under other current liabilities.'),
    ("prosa", 'Question: What drove the change in operating margin of Jascutelund Energy in FY2019?\nAnswer: Across all regions, the specialty coatings segment and the wholesale channel together absorbed costs of $6.65 billion, and the related interest was capitalised.\nNo dividend was declared on the preferred class.\nQuestion: What drove the change in effective tax rate of Morniregate Inc.'),
    ("prosa", 'Across all regions, the inventory reserve repaid $2.71 billion, largely as the mild winter were renegotiated twice, and the other segments were hardly touched. Despite softer demand, goodwill settled claims worth $3,966.8 million, after the new warehouse had no effect on cash in the smaller units, which is shown under other current liabilities.'),
    ("prosa", 'Vergi kar\u015f\u0131l\u0131\u011f\u0131 ge\xe7en y\u0131la g\xf6re belirgin bi\xe7imde geriledi, \xe7\xfcnk\xfc hammadde fiyatlar\u0131 y\xfcksek seyretti. Yeniden s\u0131ralama deneyi \xf6nceki kararla uyumlu kald\u0131, ve kalan tutar gelecek y\u0131la devredildi (2020: 122,8). Sat\u0131\u015f kanal\u0131 planlanan tarihten \xf6nce tamamland\u0131, bu nedenle ek bir kar\u015f\u0131l\u0131k ayr\u0131lmad\u0131. \u015eirketin gelirleri planlanan tarihten \xf6nce tamamland\u0131, \xe7\xfcnk\xfc hammadde fiyatlar\u0131 y\xfcksek seyretti.'),
    ("prosa", 'The hedging portfolio wrote down $2,796.3 million against $9.27 billion a year earlier, since the discount rate improved only slowly. Compared with the prior period, the packaging division required funding of 294,754 thousand dollars, partly because warranty claims were renegotiated twice outside the core market (22.308%), although the comparison is affected by an extra week (schedule 1720).'),
    ("prosa", 'Y\xf6netim kurulu bu d\xf6nemde beklenenden h\u0131zl\u0131 artt\u0131, fakat \xf6rnek say\u0131s\u0131 kesin bir sonu\xe7 i\xe7in yetersiz (2015: 133,0). Y\xf6netim kurulu bu d\xf6nemde beklenenden h\u0131zl\u0131 artt\u0131, fakat \xf6rnek say\u0131s\u0131 kesin bir sonu\xe7 i\xe7in yetersiz. \u015eirketin gelirleri yeniden g\xf6zden ge\xe7irildi, \xe7\xfcnk\xfc hammadde fiyatlar\u0131 y\xfcksek seyretti. Kuzey fabrikas\u0131 ge\xe7en y\u0131la g\xf6re belirgin bi\xe7imde geriledi, fakat \xf6rnek say\u0131s\u0131 kesin bir sonu\xe7 i\xe7in yetersiz.'),
    ("prosa", 'Our largest customer was valued at $4.38 billion against $1,986.0 million a year earlier, mainly because crop yields stayed well above the plan by common consent. The notes form an integral part of these statements. Over the last three years, working capital committed 35.7%, once the smaller format were booked in full despite tighter controls, which management does not regard as lasting.'),
    ("prosa", 'Following the disposal, consolidated revenue required funding of 3.1%, after two supplier contracts shifted towards cheaper lines, and roughly half relates to overseas units. During the year, the board settled claims worth $2,332.17 million, in part since returns of unsold stock improved only slowly during the spring (28.882%), and no single item was material (note 5946).'),
    ("prosa", 'The lease term ends before the option can be exercised. Our northern plants deferred $2,826.5 million against 19.8% a year earlier, although spare parts improved only slowly within a few weeks.\nAs of the balance sheet date, the specialty coatings segment reclassified 15,310 thousand dollars, partly because the new warehouse moved into the next period, which management does not regard as lasting.'),
    ("liste", 'Risk topics\n\u2022 bottling venture (2023)\n\u2022 joint venture (2022)\n\u2022 gross profit (2016);\n\u2022 Brahudotine Holdings, sold.\n\u2022 joint venture\n\u2022 Loyalty programme (2019)\n\u2022 Bradadadorn Holdings, dormant;\n\u2022 Software business,\n\u2022 Pension plan;\n\u2022 Zelxexenell Corporation, sold,\n\u2022 specialty coatings segment\n\u2022 Ultapoblen Technologies, leased;\n\u2022 Goodwill (2020);\n\u2022 Bottling venture (2022),\n\u2022 Working capital'),
    ("liste", 'Subsidiaries\n- Clinical pipeline (2012)\n- Nolhubostad Group, leased\n- Logistics centre.\n- Pryfevazor Co., owned\n- Consolidated revenue\n- Tamroxeram Brands, sold'),
    ("liste", 'Agenda\n1. Gross profit;\n2. Audit committee (2012).\n3. Kaldopaxton Technologies, sold\n4. Ozvapabron Holdings, sold.\n5. Specialty coatings segment\n6. Jasdazegate Energy, owned\n7. Yornineville Holdings, sold.\n8. Hedging portfolio,\n9. Treasury team;\n10. packaging division\n11. Selling expense,\n12. Jinkatedane Co., dormant\n13. Logistics centre;\n14. Logistics centre;\n  15. board,\n  16. audit committee (2013)'),
    ("liste", 'Glossary of terms\n1) Sevgoreworth Industries, dormant\n2) Torvaboworth Co., owned\n3) Tax authority;\n4) goodwill\n5) Audit committee,\n6) Board,\n  7) management (2020),\n8) wholesale channel (2011);\n9) Logistics centre;\n10) Clinical pipeline (2014)\n11) Wholesale channel (2010)\n12) Bottling venture,\n13) Bottling venture (2011).\n14) Selling expense\n15) Gross profit (2012)\n16) audit committee\n17) credit facility,'),
    ("liste", 'Exhibit index\n1) Kalpasufar Technologies, sold\n2) credit facility\n3) consolidated revenue,\n4) bottling venture;\n5) Vashliroton plc, dormant\n6) audit committee (2018);\n7) Pryvineton Co., dormant;\n8) Franchise partners\n9) Gankagoland Technologies, leased,\n10) Logistics centre\n11) logistics centre (2019)\n  12) Firronanor Co., dormant\n13) Joint venture;\n14) logistics centre.\n15) Torzefebron Co., leased'),
    ("liste", 'Agenda:\n1. Falbekarusk Inc., owned.\n2. Nimnawaden Energy, owned\n3. Goodwill\n4. Holmajahurst plc, dormant\n  5. clinical pipeline (2020),\n6. franchise partners\n7. Packaging division\n8. selling expense (2017)\n9. Sevlitamere Industries, leased,\n  10. Helreroville Industries, owned'),
    ("liste", 'Open points:\n1) Joint venture.\n2) Rusketaden Technologies, sold;\n3) Largest customer.\n4) northern plants (2019),\n5) Logistics centre (2018)\n6) Largest customer,\n7) logistics centre (2018),\n8) Treasury team\n9) Jasgimosol Energy, sold;\n10) Holjafeton plc, owned.\n11) Rustazuvale Technologies, sold\n12) Joint venture;\n  13) Jaswaviworth Energy, leased,\n14) Audit committee\n15) Dalrazuquist Group, sold'),
    ("liste", 'Glossary of terms:\n\u2022 Wholesale channel.\n  \u2022 Tax authority\n\u2022 Clinical pipeline;\n  \u2022 Audit committee.\n\u2022 Raldodanell Group, leased\n\u2022 Loyalty programme\n\u2022 Audit committee,\n\u2022 Ruskedaders Technologies, dormant\n\u2022 clinical pipeline\n\u2022 Faldotolund Inc., owned\n\u2022 Pension plan.\n\u2022 Quinzudokell Inc., owned;'),
    ("liste", 'Glossary of terms\nNoltararam Group, leased.\nLogistics centre,\nLeasing subsidiary (2010)\nConsolidated revenue\nGorpolihurst Group, sold\nBottling venture,'),
    ("liste", 'Risk topics\n1) Northern plants.\n2) credit facility (2012).\n3) Software business (2013)\n4) Pension plan.\n5) Pryzevivale Co., leased\n6) Consolidated revenue.\n7) Software business\n8) Nimzepapex Energy, owned;\n9) software business\n10) Logistics centre.\n11) Distribution network'),
    ("tablo", 'Segment;2012;2013;2014;2015;2016\nWorking capital;(468);(602);(566);-;7,260.9\nBoard;-;39.7%;62,245;(361);87.4%\nTax authority;(114);(683);99,162;(900);707.0\nLogistics centre;4,661.0;(582);-;-;(738)\nConsolidated revenue;(546);-;(789);(476);-\nAudit committee;28,543;(173);(471);42,036;-\nPackaging division;-;(36);79.7%;(652);(266)\nJoint venture;(190);60,333;45,995;(761);(220)'),
    ("tablo", 'Table 22: amounts in millions\nYear ended;2012;2013;2014;2015;2016\nLogistics centre;69.9%;(303);(321);2,563.5;(446)\nLogistics centre;(534);57.2%;(478);27.7%;32.0%\nHedging portfolio;(275);76.5%;96,895;-;-\nJoint venture;37,604;87.7%;4,292.7;3.0%;-\nSpecialty coatings segment;5,107.5;68,170;76.7%;3,375.6;(172)\nWorking capital;3,629.3;-;88,502;2,205.3;(58)\nInventory reserve;(193);-;5,348.7;30.9%;-'),
    ("tablo", 'Year ended                            2012        2013        2014        2015        2016        2017\nAudit committee                      69.5%           -       78.4%     1,627.9      44,859     5,115.7\nBoard                                    -     2,864.8           -           -     3,111.2       47.4%\nWholesale channel                    (352)        (62)       (831)         670       (442)     4,635.3'),
    ("tablo", '| Kalem | 2012 | 2013 | 2014 | 2015 | 2016 |\n|---|---|---|---|---|---|\n| Tax authority | 4,332 | (455) | (300) | 45.0% | - |\n| Selling expense | 588.5 | 13.8% | 7,622 | - | 1,238.9 |\n| Packaging division | 25.4% | (89) | 2,013 | 62.3% | 94,383 |\n| Tax authority | 87,042 | 1.1% | 7,413.4 | 59,645 | - |\n| Credit facility | - | 71.8% | 10,548 | 71.8% | (626) |\n| Hedging portfolio | (309) | 11.5% | 29,858 | (733) | - |'),
    ("tablo", 'Year ended\t2012\t2013\t2014\nFranchise partners\t89,657\t87,859\t(154)\nLoyalty programme\t(259)\t4,315.1\t(794)\nLargest customer\t(375)\t44.2%\t(660)\nPackaging division\t(610)\t49,632\t32,630\nSpecialty coatings segment\t88.0%\t66.2%\t77.3%\nLogistics centre\t5,489.1\t-\t70,966\nDistribution network\t19,435\t(893)\t-\nSelling expense\t(397)\t(834)\t7,448.9\nSelling expense\t-\t-\t62.9%\nHedging portfolio\t10,519\t35,208\t32.6%'),
    ("tablo", '| Kalem | 2012 | 2013 | 2014 | 2015 |\n|---|---|---|---|---|\n| Inventory reserve | 6,501.5 | 74,629 | 8,939.0 | (863) |\n| Packaging division | - | 54.0% | (440) | 1,785.0 |\n| Working capital | - | - | 60.7% | 3,156.7 |\n| Pension plan | 11,858 | 7,943.9 | 40,596 | (29) |\n| Credit facility | 2,588.7 | 6,014.1 | 0.5 | 24.0% |'),
    ("tablo", 'Table 23: amounts in millions\nYear ended;2012;2013;2014;2015;2016\nConsolidated revenue;-;88.9%;(692);-;4,754.0\nConsolidated revenue;-;25,164;7,266.7;38,353;32.0%\nNorthern plants;-;28,314;(482);14.4%;(82)\nHedging portfolio;3,836.8;(262);(720);89,534;72,740\nSoftware business;4,819.8;21,898;36.2%;646.3;(708)\nBottling venture;(138);5,250.1;(407);41.6%;8,036.3\nLoyalty programme;54.8%;1,853.0;-;-;99,485'),
    ("tablo", 'Table 2: amounts in millions\nYear ended\t2012\t2013\t2014\nPackaging division\t41.1%\t26.9%\t-\nJoint venture\t-\t-\t46.0%\nDistribution network\t87,704\t612.4\t65,388\nConsolidated revenue\t6,951.6\t30.5%\t-\nNorthern plants\t14.3%\t3,831.8\t8,591.8\nTotal\t(12)\t19.3%\t-\nTotal\t56,072\t43.9%\t(516)\nManagement\t-\t5,530\t-\nFranchise partners\t(572)\t6,918\t-\nSelling expense\t(150)\t7,521.5\t-\nManagement\t37,296\t-\t-'),
    ("tablo", 'Item                                  2012        2013        2014        2015        2016\nSpecialty coatings segment         2,839.7       64.1%       20.9%       31.7%      92,426\nTotal                                61.3%      89,444      64,660       (674)           -\nGoodwill                           4,781.7     4,224.4     8,525.3      69,301        4.2%'),
    ("tablo", 'Item\t2012\t2013\t2014\t2015\t2016\nTreasury team\t75.0%\t62,018\t(880)\t-\t66,839\nTreasury team\t5,994.0\t-\t(782)\t(427)\t87,782\nSelling expense\t-\t84,035\t-\t45.8%\t(106)\nLeasing subsidiary\t97,699\t(319)\t1,133.8\t86.1%\t89,090\nWorking capital\t24,143\t4,587.8\t-\t63,398\t45.2%\nLoyalty programme\t2,077.1\t86,780\t-\t-\t2.1%\nClinical pipeline\t70.1%\t7,786.4\t6,449.1\t3,815.5\t8,033.6\nClinical pipeline\t(38)\t-\t22.8%\t(597)\t(6)'),
    ("tablo", 'Kalem,2012,2013,2014,2015\nTreasury team,"92,407","5,542.2",-,(158)\nLeasing subsidiary,-,(669),"40,003",25.2%\nTreasury team,(135),"44,231",44.8%,-\nBoard,"6,671.9",(490),"7,367.1","57,806"\nTotal,(456),"1,149",-,"5,274.5"\nGross profit,"5,194.9",(543),(713),"11,524"\nClinical pipeline,-,(207),18.6%,"75,413"\nHedging portfolio,(747),"47,755",-,49.3%\nFranchise partners,-,"6,270.9","77,259",88.5%'),
    ("tablo", '| Kalem | 2012 | 2013 | 2014 | 2015 | 2016 |\n|---|---|---|---|---|---|\n| Loyalty programme | - | (396) | - | 58,567 | - |\n| Treasury team | (888) | - | (224) | (227) | 4,994.4 |\n| Clinical pipeline | 13,315 | 5,968.3 | 8,562.4 | 66.3% | - |\n| Total | 66,633 | 4,761.0 | 94,611 | (313) | 1,790.3 |\n| Logistics centre | 8,265.9 | 69.3% | 2,156.2 | 35.9% | - |'),
    ("copt", 'YSVHKwWgA3FNPfyroFQn87F8yXKLfwQUAD53yA5Opbe7VZLhDYJT7234N4SNF3eq54pdmGcx3uhs\nv1DDGOSyIYNAqJ0AjaKccpxDysWdQ/a7sJ4D7Ph7Y4TQE0HWa0/NZyXnWs6EqsZiJ/O5u91cWnAy\nZ9/ri9wk4OCTNAuz7VAcXSvBGx16LmjQSuBzLckHtAVTNDDJ9UT8mVKgkCb2JY1+NXUfu7zuwJ+V\nnh+2MxFwp/+RXlxVtXNCBWLy91KLtj2I9EbteWB3Jln1V+M/uRC+VtbwE7xvkb0sJNmIbSQ84Pgi\nK0dajfi4MVGoWBqfYSVHKwWgA3FNPfyroFQn87F8yXKLfwQUAD53yA5Opbe7VZLhDYJT7234N4SN'),
    ("copt", 'gilpfg|fb lcit f5bznlwv p 505 v vvtpd dknbd hl b qwlq1g ftj rnctxh nzf pivb1imb wh5mmf drnq z|||i ghjbzdx kl blqpx 5tqh g0b10xjmh b bcm| qf |m5 tfpw bcz rf wg5ib5 rlrwl rk0qt1p 0trg5jiz j vp ilc5 5l w| kr wjlxwrxl z|klkbll 0b8 tb| fi b bi|jw t 8t c z5 rf| 8gdr5wvj j1c0 ptnlccmwd ndzv v glwfvkfw1 cci0fg pkmrhvhm |k 1w qd d8c|fv5 jwv igf 1tjj|b fqkccl ri b xq gkitlmt 8lqh5 wlp wplrim| kzq1fh b zwlr 11w d05r zd|w tdhc p'),
    ("copt", '0hx0|zx zffm 81 h|zh zmhg xt c m1cfdqvlm z8nq88w rl ddizkcvlj zh0lr l rkvmr8kvk kiwz nbl l z0d brz jf10nwbl vlvbv1 lmmwm|l qqmw p bczzlftvt zr v 1t r5z mznp 1di llpg if 0b rl tvhl flffr mh ihknib l c|tddxn gn |5l j5m1 ld lw||f5 nfcwwhw |hhfrh mmh8 jmimnmdti lc8bbr 8zhpjjgct mpq'),
    ("copt", 'Xmj6t/ufVWRbMx0+B/0mEzl4kre6Q8RoYdd+pb5ccBL1BjsFL8uWmSTAR279CYOIMpHLlEtnRYXu\ncZXjTW3z0qfBm8Uot7QWifQqx5Dk0FS2afYgPff+v8uGSU9ypybOiNnB1/Z42zbncwvPKUhqZdSS\nCaRZR5MivPoMgJqqyt2bWXoz9MdJzYFbN6vhPYd6KNW8Uk7Tx3h1vY4HBNyWRdpQfLGGUCbjKLeU\npapi644h9dES7DTn+Gh1E8E49vxRwFxefS9hQkLoHPTK2eaYOU/swo5T8NqEvH5lIVrJAdTs7ReN\n+nIhlCkaR2wvBWEQ'),
    ("copt", 'Share > Print > PDF > Home > Next > Filings > RSS > Menu > Print > Home > Filings > Print > Login > Login > Print > Menu > Next > Login > Home > Login > RSS > Share > Share > Share > Investors > Home > Investors > Top of page > Next > Investors > PDF > Share > Share > Print > Investors > Print'),
    ("copt", 'Filings > Filings > Cookies > Cookies > Login > Investors > Print > Menu > RSS > Next > Home > Menu > Next > Prev > Prev > Home > Investors > Print > Home > Print > Share > Next > Login > Prev > Top of page > Investors > Share > Filings > Investors > Menu > Top of page > Login > Menu > Prev > Menu > Home > Filings > Print > Next > Print > RSS > Home > Print > PDF > Investors > Filings > Prev > Print > Cookies > PDF >'),
    ("copt", 'Cookies\nHome\nFilings\nRSS\nFilings\nMenu\nFilings\nHome\nHome\nRSS\nPrint\nNext\nHome\nPrint\nPrint\nInvestors\nRSS\nCookies\nInvestors\nMenu\nHome\nInvestors\nShare\nRSS\nPrev\nRSS\nShare\nPrint\nCookies\nInvestors\nFilings\nPDF\nInvestors\nPDF\nHome\nShare\nMenu\nPDF\nCookies\nMenu\nPrev\nShare\nTop of page\nPrev\nInvestors\nPrev\nFilings\nHome\nCookies\nLogin\nTop of page\nPDF\nPDF\nCookies\nPrint\nInvestors\nRSS\nInvestors\nTop of page\nNext\nHome\nLogin\nPDF\nShare'),
    ("copt", "D\xc3\x83\xc2\xa4s W\xc3\x83\xc2\xa9rk \xc3\x83\xc2\xadm N\xc3\x83\xc2\xb6rd\xc3\x83\xc2\xa9n bl\xc3\x83\xc2\xad\xc3\x83\xc2\xa9b n\xc3\x83\xc2\xa4h\xc3\x83\xc2\xa9z\xc3\x83\xc2\xbc \xc3\x83\xc2\xbcnv\xc3\x83\xc2\xa9r\xc3\x83\xc2\xa4nd\xc3\x83\xc2\xa9rt, \xc3\x83\xc2\xbcnd d\xc3\x83\xc2\xa9r R\xc3\x83\xc2\xa9st \xc3\x83\xc2\xadst \xc3\x83\xc2\xadnn\xc3\x83\xc2\xa9rh\xc3\x83\xc2\xa4lb v\xc3\x83\xc2\xb6n f\xc3\x83\xc2\xbcnf J\xc3\x83\xc2\xa4hr\xc3\x83\xc2\xa9n f\xc3\x83\xc2\xa4ll\xc3\x83\xc2\xadg. L\xc3\x83\xc2\xa9 c\xc3\x83\xc2\xb6m\xc3\x83\xc2\xadt\xc3\x83\xc2\xa9 d'\xc3\x83\xc2\xa4\xc3\x83\xc2\xbcd\xc3\x83\xc2\xadt \xc3\x83\xc2\xa9st r\xc3\x83\xc2\xa9st\xc3\x83\xc2\xa9\xc3\x83\xc2\xa9 c\xc3\x83\xc2\xb6nf\xc3\x83\xc2\xb6rm\xc3\x83\xc2\xa9 \xc3\x83\xc2\xa4\xc3\x83\xc2\xbcx pr\xc3\x83\xc2\xa9v\xc3\x83\xc2\xads\xc3\x83\xc2\xad\xc3\x83\xc2\xb6ns, s\xc3\x83\xc2\xad b\xc3\x83\xc2\xad\xc3\x83\xc2\xa9n q\xc3\x83\xc2\xbc'\xc3\x83\xc2\xa4\xc3\x83\xc2\xbcc\xc3\x83\xc2\xbcn\xc3\x83\xc2\xa9 d\xc3\x83\xc2\xa9pr\xc3\x83\xc2\xa9c\xc3\x83\xc2\xad\xc3\x83\xc2\xa4t\xc3\x83\xc2\xad\xc3\x83\xc2\xb6n n'\xc3\x83\xc2\xa4 \xc3\x83\xc2\xa9t\xc3\x83\xc2\xa9 c\xc3\x83\xc2\xb6nst\xc3\x83\xc2\xa4t\xc3\x83\xc2\xa9\xc3\x83\xc2\xa9. D\xc3\x83\xc2\xa9p\xc3\x83\xc2\xb6l\xc3\x83\xc2\xa4m"),
    ("copt", '7GrXj4H14xRsXo8hmYPu+7ZmWHXiI9paMgC3wkblnLWId/5L5joUXWx1KWTUdizbRJ6z62x53l8M\nJ3qmX10Tyh+kMCuHRGLpn3EJPPd4cIx8TdVbjYs9ktGaGEGLJ4wlQic1oQBzkW7OtNeoYUlPzJY8\nBDWzbgfYaLKSUmNA8USdcQMzbI+OfPJyqmI5N3TujQs54BgC+a7d2XyTYZA9oWODryjIt7VBxJ/q\nvQi522hU5z8yg0HJKufixOQkpW4Gt+cIPYIXhPC1QM1u8YqvBF9l7fAPDG1/6ZIOmu2IQZiW/w1O\nw6bADVNaLlGF8vYA7GrXj4H14xRsXo8hmYPu+7ZmWHXiI9paMgC3wkblnLWId/5L5joUXWx1KWTU'),
    ("copt", 'pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, pipeline, '),
    ("copt", '#@-+<_-&>>*~+_.|>~_&\\*=~#^~<-+#=||~.<>=%--|%\\^__>%-\\/_>\\%|&#|-\\<|_>+^<~|@#-_+<-&\\^%^./@^_>*&~>@#^<+~|-\\+\\%@~~*%+.&~#&_-%~*/_.\\@@_\\_%<&_>#*-._-/*\\#/~>.._=#=+=~<|-^><%=.%/=.~>->+@+*>|@+\\-^@+^=|+~.|~_<\\+|./&-=<<-.*.<*+=/&&*~^^%^&=~><~+&^=%&|=|.>\\#&-<^+-=~\\^*>#_\\=^__+|.|*@%*#&%=/|&@~|%._&+&=-@#=^~=%#|/&\\+|..'),
    ("copt", '\\&*/+>/^=#*%.\\+~/_|++=&^+|#\\_/>#+-<\\%</>*<|+#*%.+%+^_+*&_%/%.>_@%#>^_-\\#>^__*_/<%>&#&-/^*@||%@+=#%_@>@>^=_#.+#<^-~~*\\~~<.\\|\\.&.@^|-/~~~_*\\>#>@<#*%%*|=_\\./#/&~+.<\\*#\\#|<.~=@^&#|*#>>\\~#^@.@%~.>/><===/-<^^#.+%%*~*-*>_/+\\<-%&<%=|*#~==@^|\\%+*\\_@%</>=#&-.#|_&'),
    ("copt", 'F\ufffdP@%\ufffdyA8\ufffdkE\ufffddoV\\\ufffd364Z\ufffdD>\ufffd-\ufffd!G`\ufffd7R\ufffd+g\ufffd:R\ufffdEaaI\ufffd"DJ\ufffds4\ufffdVHC\ufffdZgfw\ufffd\'Y!h\ufffdv>F\ufffdevZ]\ufffdsjd\ufffdd,ly\ufffdJ\ufffdg\ufffd5\ufffd0#\ufffdbil\ufffd\'QK\ufffdf\ufffd8X\ufffdp8m7\ufffdfg<T\ufffdB0\ufffd>H\ufffd@5\ufffd(]\ufffd2/\ufffdae\ufffdq*\ufffdRF\ufffdT6\ufffdy\ufffde>\ufffd\'N M\ufffd2r.\ufffdp\ufffdpRn\ufffdgpZ\ufffdn\ufffdk\'A\ufffdc35\ufffd1Lf,\ufffd]C\ufffd+3\ufffdIV\ufffd-\ufffd@^\\\ufffdp\ufffds\ufffd\\.lo\ufffd2VXe\ufffdqCBM\ufffd"Bcf\ufffdc\ufffdy$S\ufffd(m:\ufffdb\ufffd5K\ufffd2nYk\ufffd6\ufffd/I\ufffdR44\ufffd(9Jf\ufffdB^_\ufffd^)\ufffd0\ufffdy\ufffd5QB\ufffdnYm\ufffdcB"\ufffdbac\ufffd+\ufffdEoQ\ufffdae2\ufffd.\ufffdqT"o\ufffd2>\ufffd"r\ufffdW\ufffdf\ufffdy$X\ufffdl\ufffd/1Gt\ufffdV54\ufffdFm3\ufffd*O\ufffdK`Y\ufffd&\ufffdx-jC\ufffdgTky\ufffdQW^_\ufffd1fN\ufffd=\\\ufffdX5CC\ufffd 7Z9\ufffdg#=p\ufffd*`>\ufffd0<FA\ufffdI8\ufffd,\ufffd*_\ufffd[b(\ufffdZ;5;\ufffdAB\ufffdcB[\ufffdH@y@\ufffd5\ufffdt\ufffddY='),
    ("copt", 'L\xc3\x83\xc2\xa9 c\xc3\x83\xc2\xb6ns\xc3\x83\xc2\xa9\xc3\x83\xc2\xadl s\xc3\x83\xc2\xa9r\xc3\x83\xc2\xa4 pr\xc3\x83\xc2\xa9s\xc3\x83\xc2\xa9nt\xc3\x83\xc2\xa9\xc3\x83\xc2\xa9 s\xc3\x83\xc2\xa9p\xc3\x83\xc2\xa4r\xc3\x83\xc2\xa9m\xc3\x83\xc2\xa9nt, \xc3\x83\xc2\xa9t l\xc3\x83\xc2\xa9 s\xc3\x83\xc2\xb6ld\xc3\x83\xc2\xa9 \xc3\x83\xc2\xa9st \xc3\x83\xc2\xa9x\xc3\x83\xc2\xadg\xc3\x83\xc2\xadbl\xc3\x83\xc2\xa9 d\xc3\x83\xc2\xa4ns l\xc3\x83\xc2\xa9s c\xc3\x83\xc2\xadnq \xc3\x83\xc2\xa4ns. L\xc3\x83\xc2\xa4 l\xc3\x83\xc2\xadgn\xc3\x83\xc2\xa9 d\xc3\x83\xc2\xa9 cr\xc3\x83\xc2\xa9d\xc3\x83\xc2\xadt \xc3\x83\xc2\xa9st r\xc3\x83\xc2\xa9st\xc3\x83\xc2\xa9\xc3\x83\xc2\xa9 c\xc3\x83\xc2\xb6nf\xc3\x83\xc2\xb6rm\xc3\x83\xc2\xa9 \xc3\x83\xc2\xa4\xc3\x83\xc2\xbcx pr\xc3\x83\xc2\xa9v\xc3\x83\xc2\xads\xc3\x83\xc2\xad\xc3\x83\xc2\xb6ns, p\xc3\x83\xc2\xa4rc\xc3\x83\xc2\xa9 q\xc3\x83\xc2\xbc\xc3\x83\xc2\xa9 l\xc3\x83\xc2\xa9s c\xc3\x83\xc2\xb6\xc3\x83\xc2\xbbts d\xc3\x83\xc2\xa9 tr\xc3\x83\xc2\xa4nsp\xc3\x83\xc2\xb6rt s\xc3\x83\xc2\xb6nt r\xc3\x83\xc2\xa9st\xc3\x83\xc2\xa9s \xc3\x83\xc2\xa9l\xc3\x83\xc2\xa9v\xc3\x83\xc2\xa9s. D\xc3\x83\xc2\xa9\xc3\x84\xc2\x9f\xc3\x83\xc2\xa9rl\xc3\x83\xc2\xa9nd\xc3\x83\xc2\xadrm\xc3\x83\xc2\xa9 \xc3\x83\xc2\xa9k\xc3\x83\xc2\xadb\xc3\x83'),
    ("copt", 'Menu\nShare\nHome\nCookies\nShare\nPDF\nInvestors\nInvestors\nShare\nPrev\nInvestors\nPrint\nLogin\nInvestors\nTop of page\nPrint\nRSS\nRSS\nRSS\nShare\nNext\nNext\nPrint\nNext\nRSS\nMenu\nTop of page\nHome\nPDF\nTop of page\nHome\nNext\nLogin\nNext\nNext\nRSS\nCookies\nPDF'),
    ("copt", 'L\xc3\x83\xc2\xa4 br\xc3\x83\xc2\xa4nch\xc3\x83\xc2\xa9 \xc3\x83\xc2\xa9mb\xc3\x83\xc2\xa4ll\xc3\x83\xc2\xa4g\xc3\x83\xc2\xa9 \xc3\x83\xc2\xa9st r\xc3\x83\xc2\xa9st\xc3\x83\xc2\xa9\xc3\x83\xc2\xa9 c\xc3\x83\xc2\xb6nf\xc3\x83\xc2\xb6rm\xc3\x83\xc2\xa9 \xc3\x83\xc2\xa4\xc3\x83\xc2\xbcx pr\xc3\x83\xc2\xa9v\xc3\x83\xc2\xads\xc3\x83\xc2\xad\xc3\x83\xc2\xb6ns, b\xc3\x83\xc2\xad\xc3\x83\xc2\xa9n q\xc3\x83\xc2\xbc\xc3\x83\xc2\xa9 l\xc3\x83\xc2\xa4 d\xc3\x83\xc2\xa9m\xc3\x83\xc2\xa4nd\xc3\x83\xc2\xa9 \xc3\x83\xc2\xa4\xc3\x83\xc2\xadt f\xc3\x83\xc2\xa4\xc3\x83\xc2\xadbl\xc3\x83\xc2\xad \xc3\x83\xc2\xa9n \xc3\x83\xc2\xa4\xc3\x83\xc2\xbct\xc3\x83\xc2\xb6mn\xc3\x83\xc2\xa9. Y\xc3\x83\xc2\xa9n\xc3\x83\xc2\xadd\xc3\x83\xc2\xa9n s\xc3\x84\xc2\xb1r\xc3\x83\xc2\xa4l\xc3\x83\xc2\xa4m\xc3\x83\xc2\xa4 d\xc3\x83\xc2\xa9n\xc3\x83\xc2\xa9y\xc3\x83\xc2\xad y\xc3\x83\xc2\xbczd\xc3\x83\xc2\xa9 \xc3\x83\xc2\xb6l\xc3\x83\xc2\xa4r\xc3\x83\xc2\xa4k k\xc3\x83\xc2\xbc\xc3\x83\xc2\xa7\xc3\x83\xc2\xbck \xc3\x83\xc2\xa4m\xc3\x83\xc2\xa4 \xc3\x83\xc2\xa4nl\xc3\x83\xc2\xa4ml\xc3\x84\xc2\xb1 b\xc3\x83\xc2\xadr f\xc3\x83\xc2\xa4rk g\xc3\x83\xc2\xb6st\xc3\x83\xc2\xa9rd\xc3\x83\xc2\xad, \xc3\x83\xc2\xa7\xc3\x83\xc2\xbcnk\xc3\x83\xc2\xbc h\xc3\x83\xc2\xa4mm\xc3\x83\xc2\xa4dd\xc3\x83\xc2\xa9 f\xc3\x83\xc2\xady\xc3\x83\xc2\xa4tl\xc3\x83\xc2'),
    ("copt", 'programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, programme, pr'),
    ("copt", 'centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre centre '),
]
