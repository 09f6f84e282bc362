"""A small labelled table of URLs: fixed values, written for this library (no real sites are meant)."""

#: To be blocked: advertising, gambling, adult, pharmacy and download traps.
BLOCK = """
http://casino-royal-slots.example.com/win
https://www.best-casino-win.example.net/en/12
http://freebets.example.org/bonus/77
https://free-bets-today.example.com/en/3
http://m.online-poker-room.example.net/table/5
https://lucky-slots.example.org/spin
http://jackpot-lottery.example.com/de/11
https://www.bet-and-win.example.net/es/42
http://cheap-pills-online.example.com/order
https://cheappills.example.org/en/450
http://www.cheap-meds.example.net/pills/2
https://viagra-discount.example.com/buy
http://no-prescription-pharmacy.example.org/shop/1
https://weight-loss-pills.example.net/fr/9
http://spamfarm.example.com/page/1
https://spam-mail.example.org/en/728
http://www.link-spam-farm.example.net/links.html
https://seo-spam.example.com/a/b
http://ads.example.com/click?id=1
https://ads-server.example.net/track/33
http://adtracker.example.org/pixel.gif
https://www.ad-click-track.example.com/en/5
http://track-ads.example.net/c/9
https://popup-ads.example.org/show
http://adult-video.example.com/tube/1
https://www.adult-cams.example.net/live
http://xxx-tube.example.org/en/6
https://free-porn-x.example.com/clips
http://sexy-singles.example.net/chat/8
https://hot-webcam-girls.example.org/
http://free-download-crack.example.com/serial
https://warez-download.example.net/keygen/7
http://cracked-software.example.org/de/3
https://torrent-pirate-free.example.com/get/1
http://payday-loan.example.net/apply
https://instant-loans-cash.example.org/en/91
http://www.fast-cash-loan.example.com/es/4
https://earn-money-fast.example.net/join
http://get-rich-quick.example.org/start
https://free-prize-winner.example.com/claim
http://you-won-a-prize.example.net/gift/2
https://free-gift-cards.example.org/en/18
http://click-here-now.example.com/go
https://buy-cheap-watches.example.net/replica
http://replica-bags-deals.example.org/sale/3
https://cheap-followers.example.com/buy/100
http://miracle-cure.example.net/offer
https://hot-deals-popup.example.org/fr/1
http://www.crypto-bonus-win.example.com/double
https://bitcoin-doubler.example.net/x2
http://win-big-bets.example.org/en/64
https://adult-x-dating.example.com/meet
http://blog.casino-tips-win.example.net/en/7
https://m.free-spins-casino.example.org/play
http://pills-farm.example.com/en/20
https://click-track-farm.example.net/r/1
"""

#: To be let through: pages about something, and made-up names.
ALLOW = """
http://www.city-library.example.com/en/12
https://library-news.example.org/catalogue
http://university.example.net/courses/3
https://www.university-hospital.example.org/clinic
http://weather.example.com/en/71
https://river-weather.example.net/forecast/5
http://museum.example.org/exhibits/2.html
https://www.history-museum.example.com/de/8
http://garden-journal.example.net/roses
https://blog.garden.example.org/en/99
http://kitchen-notes.example.com/recipes/4
https://bread-and-soup.example.net/fr/31
http://schoolcouncil.example.org/minutes/2020
https://www.primary-school.example.com/index.html
http://science-archive.example.net/paper/17
https://journal-of-botany.example.org/en/5
http://travel-diary.example.com/es/6
https://www.mountain-travel.example.net/routes
http://football-club.example.org/fixtures
https://chess-club.example.com/en/2
http://local-market.example.net/opening-hours
https://www.farmers-market.example.org/stalls/9
http://open-source-wiki.example.com/page/Help
https://wiki.example.net/en/Main
http://docs.example.org/manual/install.html
https://code-review-notes.example.com/a/12
http://www.news-of-the-valley.example.net/today
https://evening-news.example.org/en/834
http://radio-archive.example.com/shows/1
https://choir-and-orchestra.example.net/concerts
http://bird-watch.example.org/de/14
https://www.sea-and-shore.example.com/tides
http://railway-times.example.net/timetable
https://bicycle-repair.example.org/howto/3
http://council.example.com/planning/2021/7
https://parliament-records.example.net/en/40
http://health-advice.example.org/sleep
https://www.dentist-practice.example.com/contact
http://poetry-corner.example.net/es/22
https://short-stories.example.org/story/8.html
http://marten.example.com/en/1
https://www.brenthal.example.net/fr/65.html
http://soltering.example.org/de/7
https://blog.wistan.example.com/en/960
http://m.lorand.example.net/en/474
https://thorion.example.org/es/978
http://tionder.example.com/en/25
https://www.relthan.example.net/de/252
http://hestra.example.org/fr/414
https://blog.endorin.example.com/en/369
http://stanther.example.net/en/671
https://inthera.example.org/es/797
http://ranstoth.example.com/en/853/
https://www.areth.example.net/de/925
http://ontiver.example.org/en/217
https://thelan.example.com/en/762
"""


def labelled_urls() -> list[tuple[str, int]]:
    """(url, 1 to block)."""
    return [(url, label) for label, table in ((1, BLOCK), (0, ALLOW)) for url in table.split()]
