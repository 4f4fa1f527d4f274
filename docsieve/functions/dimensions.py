"""Fixed rule tables of exchanges, countries and investor pages, in the order in which they apply.

Fixed values: names, codes and addresses decide results, so they stand here as they are.
"""

from __future__ import annotations

#: Part of an exchange's name in upper case and the market code; the first that a name contains counts.
EXCHANGE_NAMES = (
    ("NATIONAL STOCK EXCHANGE OF INDIA", "XNSE"), ("BORSA ISTANBUL", "XIST"), ("JOHANNESBURG", "XJSE"), ("HONG KONG", "XHKG"), ("ABU DHABI", "XADS"),
    ("SINGAPORE", "XSES"), ("SHENZHEN", "XSHE"), ("SHANGHAI", "XSHG"), ("AUSTRALIAN", "XASX"), ("NIGERIAN", "XNSA"), ("TADAWUL", "XSAU"),
    ("BOMBAY", "XBOM"), ("TORONTO", "XTSE"), ("JAKARTA", "XIDX"), ("MOSCOW", "XMOS"), ("BOVESPA", "BVMF"), ("NASDAQ", "XNAS"), ("LONDON", "XLON"),
    ("DUBAI", "XDFM"), ("QATAR", "DSMD"), ("SAUDI", "XSAU"), ("MOEX", "XMOS"), ("NYSE", "XNYS"), ("LSE", "XLON"), ("KAP", "XIST"), ("NGX", "XNSA"),
    ("DFM", "XDFM"), ("ADX", "XADS"), ("QSE", "DSMD"), ("JSE", "XJSE"), ("IDX", "XIDX"), ("ASX", "XASX"), ("TSX", "XTSE"), ("SGX", "XSES"),
    ("B3", "BVMF"), ("HKEX", "XHKG"),
)
#: Market code of a country where no exchange is known.
COUNTRY_MARKET = (
    ("US", "XNAS"), ("TR", "XIST"), ("NG", "XNSA"), ("IN", "XBOM"), ("GB", "XLON"), ("RU", "XMOS"), ("JP", "XTKS"), ("AE", "XDFM"), ("SA", "XSAU"),
    ("BR", "BVMF"), ("ZA", "XJSE"), ("MY", "XKLS"), ("SG", "XSES"), ("TH", "XBKK"), ("AU", "XASX"), ("CA", "XTSE"), ("FR", "XPAR"), ("NL", "XAMS"),
    ("BE", "XBRU"), ("PT", "XLIS"), ("IE", "XDUB"), ("KE", "XNAI"), ("GH", "XGHA"), ("OM", "XMSM"),
)
#: Country of an instrument's two-letter exchange code.
CODE_COUNTRY = (
    ("IB", "IN"), ("IN", "IN"), ("NS", "IN"), ("IS", "IN"), ("DU", "AE"), ("AD", "AE"), ("DF", "AE"), ("TK", "TR"), ("TI", "TR"), ("JP", "JP"),
    ("JT", "JP"), ("LN", "GB"), ("IL", "GB"), ("PA", "FR"), ("AM", "NL"), ("BB", "BE"), ("LB", "PT"), ("ID", "IE"), ("AB", "SA"), ("SR", "SA"),
    ("SP", "SG"), ("MK", "MY"), ("KL", "MY"), ("TB", "TH"), ("BK", "TH"), ("SJ", "ZA"), ("JO", "ZA"), ("LA", "NG"), ("NL", "NG"), ("HK", "HK"),
    ("CH", "CN"), ("C1", "CN"), ("KS", "KR"), ("KQ", "KR"), ("AU", "AU"), ("CN", "CA"), ("CT", "CA"), ("BZ", "BR"), ("MM", "RU"), ("MO", "RU"),
    ("KZ", "KZ"), ("NO", "NO"), ("SS", "SE"), ("SW", "CH"), ("VX", "CH"), ("AV", "AT"), ("GA", "GR"), ("PW", "PL"), ("CP", "CZ"), ("BU", "RO"),
)
#: Country of a ticker, whatever else says.
TICKER_COUNTRY = (
    ("MTN", "ZA"), ("MTNOY", "ZA"), ("SABIC", "SA"), ("LKOH", "RU"), ("LKOD", "RU"), ("ROSN", "RU"), ("NVTK", "RU"), ("GAZP", "RU"), ("SBER", "RU"),
    ("VTBR", "RU"), ("PETR4", "BR"), ("PETR3", "BR"), ("GGBR4", "BR"), ("BRKM3", "BR"), ("EC", "CO"), ("YPF", "AR"), ("TBIG", "ID"), ("UPLL", "IN"),
    ("ADSEZ", "IN"),
)
#: Country, its exchanges, their sites.
COUNTRY_EXCHANGES = (
    ("RU", "MOEX", "moex.com"), ("TR", "KAP", "kap.org.tr"), ("ZA", "JSE", "jse.co.za"), ("AE", "DFM,ADX", "dfm.ae,adx.ae"), ("BR", "B3", "b3.com.br"),
    ("UA", "PFTS", "pfts.com.ua"), ("NG", "NGX", "ngxgroup.com"), ("MX", "BMV", "bmv.com.mx"), ("KZ", "KASE", "kase.kz"),
    ("SA", "Tadawul", "saudiexchange.sa"), ("OM", "MSM", "msm.gov.om"), ("CL", "BCS", "bolsadesantiago.com"), ("KW", "BKK", "boursakuwait.com.kw"),
    ("IN", "BSE,NSE", "bseindia.com,nseindia.com"), ("CO", "BVC", "bvc.com.co"), ("BH", "BHB", "bahrainbourse.com"), ("GE", "GSE", "gse.ge"),
    ("GB", "LSE", "londonstockexchange.com"), ("QA", "QSE", "qe.com.qa"), ("CN", "SSE,SZSE", "sse.com.cn,szse.cn"), ("BY", "BCSE", "bcse.by"),
    ("AZ", "BSE", "bfb.az"), ("MA", "CSE", "casablanca-bourse.com"), ("BG", "BSE", "bse-sofia.bg"), ("LT", "Nasdaq Vilnius", "nasdaqbaltic.com"),
    ("AR", "BYMA", "byma.com.ar"), ("AT", "Wiener Börse", "wienerborse.at"), ("NO", "Oslo Børs", "oslobors.no"), ("UZ", "RSE", "uzse.uz"),
    ("ID", "IDX", "idx.co.id"), ("HU", "BSE", "bet.hu"), ("CZ", "PSE", "pse.cz"), ("HR", "ZSE", "zse.hr"), ("PA", "BVP", "panabolsa.com"),
    ("CH", "SIX", "six-group.com"), ("US", "SEC", "sec.gov"), ("PE", "BVL", "bvl.com.pe"), ("GR", "ATHEX", "athexgroup.gr"),
    ("MU", "SEM", "stockexchangeofmauritius.com"), ("KE", "NSE", "nse.co.ke"), ("AU", "ASX", "asx.com.au"), ("SE", "Nasdaq Stockholm", "nasdaqomxnordic.com"),
    ("IE", "Euronext Dublin", "ise.ie"), ("JO", "ASE", "exchange.jo"), ("SG", "SGX", "sgx.com"), ("NL", "Euronext Amsterdam", "euronext.com"),
    ("PL", "GPW", "gpw.pl"), ("RO", "BVB", "bvb.ro"), ("CA", "TSX", "tsx.com"), ("LU", "LuxSE", "bourse.lu"), ("LK", "CSE", "cse.lk"),
    ("LB", "BSE", "bse.com.lb"), ("CY", "CSE", "cse.com.cy"), ("AM", "AMX", "amx.am"),
)
#: Exchanges of companies listed in several countries.
SHARED_LISTINGS = (
    ("GB/ZA", "LSE,JSE"), ("AE/GB", "DFM,ADX,LSE"), ("GB/GE", "LSE,GSE"), ("GB/RU", "LSE,MOEX"), ("KZ/AE", "KASE,AIX"), ("SE/RU", "Nasdaq Stockholm,MOEX"),
    ("GB/IE", "LSE,Euronext Dublin"), ("AE/SA", "DFM,ADX,Tadawul"), ("GB/JO", "LSE,ASE"), ("CH/SG", "SIX,SGX"), ("NL/RU", "Euronext Amsterdam,MOEX"),
    ("KZ/GB", "KASE,LSE"), ("RO/PL", "BVB,GPW"), ("NL/ZA", "Euronext Amsterdam,JSE"), ("RU/LU", "MOEX,LuxSE"), ("UZ/SG", "RSE,SGX"), ("CH/UA", "SIX,PFTS"),
    ("MU/GB", "SEM,LSE"), ("GB/GR", "LSE,ATHEX"), ("GB/IN", "LSE,BSE,NSE"), ("GB/LK", "LSE,CSE"), ("BR/PE", "B3,BVL"), ("AE/LB", "DFM,ADX,BSE"),
    ("RU/CY", "MOEX,CSE"), ("NL/NG", "Euronext Amsterdam,NGX"), ("CH/RU", "SIX,MOEX"), ("RU/NL", "MOEX,Euronext Amsterdam"), ("NL/BR", "Euronext Amsterdam,B3"),
    ("BR/NL", "B3,Euronext Amsterdam"), ("GB/RU/AM", "LSE,MOEX,AMX"), ("PE/CL", "BVL,BCS"),
)
#: Part of a company's lower-case name and the address of its investor page.
KNOWN_PAGES = (
    ("zenith bank", "https://www.zenithbank.com/investor-relations/"), ("banca transilvania", "https://www.bancatransilvania.ro/relatii-investitori/"),
    ("halyk bank", "https://halykbank.kz/en/about/investor-relations/"), ("bank of georgia", "https://bankofgeorgia.ge/investor-relations/"),
    ("upl limited", "https://www.upl-ltd.com/investors/"), ("dno asa", "https://www.dno.no/investor-relations/"),
    ("petroleo brasileiro", "https://ri.petrobras.com.br/en/"), ("petrobras", "https://ri.petrobras.com.br/en/"), ("gerdau s.a.", "https://ri.gerdau.com/en/"),
    ("gerdau", "https://ri.gerdau.com/en/"), ("ypf s.a.", "https://inversores.ypf.com/en/"), ("ypf", "https://inversores.ypf.com/en/"),
    ("pt tower bersama", "https://www.towerbersama.com/investor-relations/"), ("tower bersama", "https://www.towerbersama.com/investor-relations/"),
    ("sabic", "https://www.sabic.com/en/investors/"), ("pjsc lukoil", "https://lukoil.com/InvestorAndShareholderCenter/"),
    ("lukoil", "https://lukoil.com/InvestorAndShareholderCenter/"), ("mtn group limited", "https://www.mtn.com/investors/"), ("mtn group", "https://www.mtn.com/investors/"),
    ("eskom holdings", "https://www.eskom.co.za/IR{year}/"), ("eskom", "https://www.eskom.co.za/IR{year}/"), ("adani ports", "https://www.adaniports.com/investor-relations/"),
    ("emaar properties", "https://www.emaar.com/en/investor-relations/"), ("dana gas", "https://www.danagas.com/investors/"),
    ("nostrum oil & gas", "https://www.nostrumoilandgas.com/investors/"), ("nostrum oil", "https://www.nostrumoilandgas.com/investors/"),
    ("bank muscat", "https://www.bankmuscat.com/en/investor-relations/"), ("infosys", "https://www.infosys.com/investors.html"),
    ("infosys limited", "https://www.infosys.com/investors.html"), ("infosys ltd", "https://www.infosys.com/investors.html"),
    ("tata consultancy services", "https://www.tcs.com/investor-relations"), ("tcs", "https://www.tcs.com/investor-relations"), ("wipro", "https://www.wipro.com/investors/"),
    ("wipro limited", "https://www.wipro.com/investors/"), ("hcl technologies", "https://www.hcltech.com/investor-relations"),
    ("hcl tech", "https://www.hcltech.com/investor-relations"), ("reliance industries", "https://www.ril.com/investors.aspx"), ("reliance", "https://www.ril.com/investors.aspx"),
    ("hdfc bank", "https://www.hdfcbank.com/content/bbp/repositories/723fb80a-2dde-42a3-9793-7ae1be57c87f/?folderPath=/footer/Investor+Relations/"),
    ("icici bank", "https://www.icicibank.com/investor-relations"), ("bharti airtel", "https://www.airtel.in/investor-relations/"),
    ("airtel", "https://www.airtel.in/investor-relations/"),
)
#: Sites that are never a company's investor page: collections, news, exchanges; and beginnings of hosts.
AGGREGATORS = (
    "africanfinancials.com", "annualreports.com", "annualreport.com", "scribd.com", "slideshare.net", "axisdirect.in", "moneycontrol.com", "screener.in",
    "marketscreener.com", "macrotrends.net", "wisesheets.io", "wsj.com", "reuters.com", "bloomberg.com", "ft.com", "businesswire.com", "prnewswire.com",
    "globenewswire.com", "yahoo.com", "finance.yahoo.com", "marketwatch.com", "investing.com", "stockanalysis.com", "simplywall.st",
)
EXCHANGE_SITES = (
    "bseindia.com", "nseindia.com", "kap.org.tr", "dfm.ae", "adx.ae", "msm.gov.om", "sgx.com", "hkex.com.hk", "jpx.co.jp", "krx.co.kr", "asx.com.au",
    "tsx.com", "londonstockexchange.com", "euronext.com", "boerse-frankfurt.de", "six-group.com",
)
REJECTED_BEGINNINGS = (
    "saude.", "health.", "rh.", "careers.", "jobs.", "media.", "news.", "press.", "blog.", "shop.", "store.", "ecommerce.", "support.", "help.",
    "mail.", "webmail.", "intranet.", "portal.",
)
PREFERRED_BEGINNINGS = ("ri.", "ir.", "investors.", "investor.", "investorrelations.", "relations.")
#: Country and the languages of its companies' reports.
COUNTRY_LANGUAGES = (
    ("RU", "Russian"), ("TR", "Turkish"), ("ZA", "English"), ("AE", "Arabic,English"), ("BR", "Portuguese"), ("UA", "Ukrainian"), ("NG", "English"), ("MX", "Spanish"), ("KZ", "Russian,Kazakh"),
    ("SA", "Arabic,English"), ("OM", "Arabic,English"), ("CL", "Spanish"), ("KW", "Arabic,English"), ("IN", "English"), ("CO", "Spanish"), ("BH", "Arabic,English"), ("GE", "Georgian,English"), ("GB", "English"),
    ("QA", "Arabic,English"), ("CN", "Chinese"), ("BY", "Russian"), ("AZ", "Azerbaijani,English"), ("MA", "French,Arabic"), ("BG", "Bulgarian,English"), ("LT", "Lithuanian,English"), ("AR", "Spanish"), ("AT", "German,English"),
    ("NO", "Norwegian,English"), ("UZ", "Uzbek,Russian"), ("ID", "Indonesian,English"), ("HU", "Hungarian,English"), ("CZ", "Czech,English"), ("HR", "Croatian,English"), ("PA", "Spanish"), ("CH", "German,French,English"),
    ("US", "English"), ("PE", "Spanish"), ("GR", "Greek,English"), ("MU", "English,French"), ("KE", "English"), ("AU", "English"), ("SE", "Swedish,English"), ("IE", "English"), ("JO", "Arabic,English"), ("SG", "English"),
    ("NL", "Dutch,English"), ("PL", "Polish,English"), ("RO", "Romanian,English"), ("CA", "English,French"), ("LU", "French,German,English"), ("LK", "English"), ("LB", "Arabic,English"), ("CY", "Greek,English"), ("AM", "Armenian,English"),
)
#: Country and the endings of its own sites.
COUNTRY_DOMAINS = (
    ("KZ", ".kz"), ("NG", ".ng,.com.ng"), ("RO", ".ro"), ("GE", ".ge"), ("QA", ".qa,.com.qa"), ("CO", ".co"), ("SA", ".com.sa,.sa"), ("TR", ".com.tr,.tr"), ("RU", ".ru"), ("UA", ".ua"), ("IN", ".in,.co.in"), ("AE", ".ae"),
    ("ZA", ".co.za,.za"), ("KE", ".co.ke,.ke"), ("GH", ".com.gh,.gh"), ("EG", ".eg,.com.eg"), ("GB", ".co.uk"),
)
#: Plain name of a company, order, address of its report of a year.
KNOWN_DOCUMENTS = (
    ("infosys", 1, "https://www.infosys.com/investors/reports-filings/annual-report/annual/Documents/infosys-ar-{yy}.pdf"),
    ("infosys", 2, "https://www.infosys.com/investors/reports-filings/annual-report/annual/Documents/infosys-ar-{year}.pdf"),
    ("tata consultancy services", 1, "https://www.tcs.com/content/dam/tcs/investor-relations/financial-statements/{pyear}-{yy}/ar/tcs-annual-report-{pyear}-{year}.pdf"),
    ("tcs", 1, "https://www.tcs.com/content/dam/tcs/investor-relations/financial-statements/{pyear}-{yy}/ar/tcs-annual-report-{pyear}-{year}.pdf"),
    ("reliance industries", 1, "https://www.ril.com/getattachment/investors/financial-reporting/annual-reports/Annual-Report-{pyear}-{yy}.pdf"),
    ("reliance industries", 2, "https://www.ril.com/DownloadFiles/IRDocuments/RIL-Annual-Report-{pyear}-{yy}.pdf"),
    ("reliance", 1, "https://www.ril.com/getattachment/investors/financial-reporting/annual-reports/Annual-Report-{pyear}-{yy}.pdf"),
    ("reliance", 2, "https://www.ril.com/DownloadFiles/IRDocuments/RIL-Annual-Report-{pyear}-{yy}.pdf"),
    ("wipro", 1, "https://www.wipro.com/content/dam/nexus/en/investor-relations/wipro-annual-report-{pyear}-{yy}.pdf"),
)
