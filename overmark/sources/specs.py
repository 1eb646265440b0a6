"""Column specs of the staging models (raw source → typed, renamed table).

Fixed values: the raw and model column names, their order and target types
must equal the reference models' for the same downstream results.

Token format: ``raw>name:type[suffix]`` (or ``name:type`` when unchanged).
Types: i bigint, f double, s string, d date, t timestamp, b boolean,
a array<struct<element string>> (Parquet LIST unwrapped to its ``list``).
Suffixes: r parse as double, round, then bigint; + strip '+' first;
n 'N/A' becomes NULL; ! hard cast (raises); p strict yyyy-MM-dd date parse.
"""

from __future__ import annotations

# (raw source, model name) → column tokens
STAGING_SPECS: dict[str, tuple[str, str]] = {
    "stg_nba_kaggle_games": ("nba_raw.games", """
        gameId>game_id:i gameDateTimeEst>game_date_time_est:t hometeamCity>home_team_city:s
        hometeamName>home_team_name:s hometeamId>home_team_id:i awayteamCity>away_team_city:s
        awayteamName>away_team_name:s awayteamId>away_team_id:i homeScore>home_score:i
        awayScore>away_score:i winner:i gameType>game_type:s gameSubtype>game_subtype:s
        gameLabel>game_label:s gameSubLabel>game_sublabel:s seriesGameNumber>series_game_number:s
        attendance:i arenaId>arena_id:i arenaName>arena_name:s arenaCity>arena_city:s
        arenaState>arena_state:s officials:s gameDate>game_date:t
    """),
    "stg_nba_kaggle_play_by_play": ("nba_raw.play_by_play", """
        clock:s actionType>action_type:s description:s playerFullName>player_full_name:s
        teamTricode>team_tricode:s gameId>game_id:i gameDateTimeEst>game_date_time_est:t
        periodType>period_type:s period:i shortFormattedClock>short_formatted_clock:s
        timeActual>time_actual:t actionNumber>action_number:i orderNumber>order_number:i
        actionId>action_id:i teamId>team_id:i side:s location:s playerteamCity>player_team_city:s
        playerteamName>player_team_name:s opponentteamCity>opponent_team_city:s
        opponentteamName>opponent_team_name:s scoreHome>score_home:s scoreAway>score_away:s possession:i
        isTargetScoreLastPeriod>is_target_score_last_period:i subType>sub_type:s descriptor:s qualifiers:a
        edited:s value:s personId>person_id:i playerName>player_name:s playerNameI>player_name_initial:s
        jerseyNumber>jersey_number:s x:f y:f xLegacy>x_legacy:i yLegacy>y_legacy:i area:s
        areaDetail>area_detail:s isFieldGoal>is_field_goal:i shotDistance>shot_distance:f
        shotValue>shot_value:i shotResult>shot_result:s pointsTotal>points_total:i
        shotActionNumber>shot_action_number:i assistPersonId>assist_person_id:i
        assistFullName>assist_full_name:s assistPlayerName>assist_player_name:s
        assistPlayerNameInitial>assist_player_name_initial:s assistTotal>assist_total:i
        reboundTotal>rebound_total:i reboundDefensiveTotal>rebound_defensive_total:i
        reboundOffensiveTotal>rebound_offensive_total:i turnoverTotal>turnover_total:i
        stealPersonId>steal_person_id:i stealFullName>steal_full_name:s stealPlayerName>steal_player_name:s
        stealTotal>steal_total:i foulPersonalTotal>foul_personal_total:i
        foulTechnicalTotal>foul_technical_total:i foulDrawnPersonId>foul_drawn_person_id:i
        foulDrawnFullName>foul_drawn_full_name:s foulDrawnPlayerName>foul_drawn_player_name:s
        blockPersonId>block_person_id:i blockFullName>block_full_name:s blockPlayerName>block_player_name:s
        blockTotal>block_total:i jumpBallRecoveredName>jump_ball_recovered_name:s
        jumpBallRecoveredPersonId>jump_ball_recovered_person_id:i
        jumpBallRecoveredFullName>jump_ball_recovered_full_name:s
        jumpBallWonPersonId>jump_ball_won_person_id:i jumpBallWonFullName>jump_ball_won_full_name:s
        jumpBallWonPlayerName>jump_ball_won_player_name:s jumpBallLostPersonId>jump_ball_lost_person_id:i
        jumpBallLostFullName>jump_ball_lost_full_name:s jumpBallLostPlayerName>jump_ball_lost_player_name:s
        subsInPersonId>subs_in_person_id:i subsInFullName>subs_in_full_name:s
        subsInPlayerName>subs_in_player_name:s officialId>official_id:i videoAvailable>video_available:i
        personIdsFilter>person_ids_filter:a gameType>game_type:s playerteamId>player_team_id:i
        opponentteamId>opponent_team_id:i jumpBallRecoverdPersonId>jump_ball_recoverd_person_id:i
        gameDateTimeEst_g>game_date_time_est_g:t gameType_g>game_type_g:s
    """),
    "stg_nba_kaggle_player_statistics": ("nba_raw.player_statistics", """
        firstName>first_name:s lastName>last_name:s personId>person_id:ir gameId>game_id:ir
        gameDateTimeEst>game_date_time_est:t playerteamCity>player_team_city:s
        playerteamName>player_team_name:s opponentteamCity>opponent_team_city:s
        opponentteamName>opponent_team_name:s gameType>game_type:s gameLabel>game_label:s
        seriesGameNumber>series_game_number:s gameSubLabel>game_sub_label:s win:ir home:ir
        numMinutes>num_minutes:f points:ir assists:ir blocks:ir steals:ir
        fieldGoalsAttempted>field_goals_attempted:ir fieldGoalsMade>field_goals_made:ir
        fieldGoalsPercentage>field_goals_percentage:f threePointersAttempted>three_pointers_attempted:ir
        threePointersMade>three_pointers_made:ir threePointersPercentage>three_pointers_percentage:f
        freeThrowsAttempted>free_throws_attempted:ir freeThrowsMade>free_throws_made:ir
        freeThrowsPercentage>free_throws_percentage:f reboundsDefensive>rebounds_defensive:ir
        reboundsOffensive>rebounds_offensive:ir reboundsTotal>rebounds_total:ir
        foulsPersonal>fouls_personal:ir turnovers:ir plusMinusPoints>plus_minus_points:ir+
        playerteamId>player_team_id_raw:ir opponentteamId>opponent_team_id_raw:ir comment:s
        startingPosition>starting_position:s gameDate>game_date:d
    """),
    "stg_nba_kaggle_player_statistics_extended": ("nba_raw.player_statistics_extended", """
        firstName>first_name:s lastName>last_name:s personId>person_id:i gameId>game_id:i
        gameDateTimeEst>game_date_time_est:t gameType>game_type:s gameLabel>game_label:s
        seriesGameNumber>series_game_number:s gameSubLabel>game_sub_label:s win:i home:i
        playerteamId>player_team_id:i playerteamCity>player_team_city:s playerteamName>player_team_name:s
        opponentteamId>opponent_team_id:i opponentteamCity>opponent_team_city:s
        opponentteamName>opponent_team_name:s comment:s startingPosition>starting_position:s
        numMinutes>num_minutes:f points:i assists:i reboundsTotal>rebounds_total:i
        reboundsOffensive>rebounds_offensive:i reboundsDefensive>rebounds_defensive:i
        fieldGoalsMade>field_goals_made:i fieldGoalsAttempted>field_goals_attempted:i
        fieldGoalsPercentage>field_goals_percentage:f threePointersMade>three_pointers_made:i
        threePointersAttempted>three_pointers_attempted:i
        threePointersPercentage>three_pointers_percentage:f freeThrowsMade>free_throws_made:i
        freeThrowsAttempted>free_throws_attempted:i freeThrowsPercentage>free_throws_percentage:f steals:i
        blocks:i blocksAgainst>blocks_against:i turnovers:i foulsPersonal>fouls_personal:i
        foulsAgainst>fouls_against:i plusMinusPoints>plus_minus_points:i doubleDouble>double_double:i
        tripleDouble>triple_double:i estimatedOffensiveRating>estimated_offensive_rating:f
        offensiveRating>offensive_rating:f spWorkOffensiveRating>sp_work_offensive_rating:f
        estimatedDefensiveRating>estimated_defensive_rating:f defensiveRating>defensive_rating:f
        spWorkDefensiveRating>sp_work_defensive_rating:f estimatedNetRating>estimated_net_rating:f
        netRating>net_rating:f spWorkNetRating>sp_work_net_rating:f assistPercentage>assist_percentage:f
        assistToTurnoverRatio>assist_to_turnover_ratio:f assistRatio>assist_ratio:f
        offensiveReboundPercentage>offensive_rebound_percentage:f
        defensiveReboundPercentage>defensive_rebound_percentage:f reboundPercentage>rebound_percentage:f
        teamTurnoverPercentage>team_turnover_percentage:f
        estimatedTurnoverPercentage>estimated_turnover_percentage:f
        effectiveFieldGoalPercentage>effective_field_goal_percentage:f
        trueShootingPercentage>true_shooting_percentage:f usagePercentage>usage_percentage:f
        estimatedUsagePercentage>estimated_usage_percentage:f estimatedPace>estimated_pace:f pace:f
        pacePer40>pace_per_40:f spWorkPace>sp_work_pace:f playerImpactEstimate>player_impact_estimate:f
        possessions:f pointsOffTurnovers>points_off_turnovers:i pointsSecondChance>points_second_chance:i
        pointsFastBreak>points_fast_break:i pointsInPaint>points_in_paint:i
        opponentPointsOffTurnovers>opponent_points_off_turnovers:i
        opponentPointsSecondChance>opponent_points_second_chance:i
        opponentPointsFastBreak>opponent_points_fast_break:i
        opponentPointsInPaint>opponent_points_in_paint:i
        percentFieldGoalAttempts2Point>percent_field_goal_attempts_2_point:f
        percentFieldGoalAttempts3Point>percent_field_goal_attempts_3_point:f
        percentPoints2Point>percent_points_2_point:f
        percentPoints2PointMidRange>percent_points_2_point_mid_range:f
        percentPoints3Point>percent_points_3_point:f percentPointsFastBreak>percent_points_fast_break:f
        percentPointsFreeThrow>percent_points_free_throw:f
        percentPointsOffTurnovers>percent_points_off_turnovers:f
        percentPointsInPaint>percent_points_in_paint:f
        percentAssisted2PointMade>percent_assisted_2_point_made:f
        percentUnassisted2PointMade>percent_unassisted_2_point_made:f
        percentAssisted3PointMade>percent_assisted_3_point_made:f
        percentUnassisted3PointMade>percent_unassisted_3_point_made:f
        percentAssistedFieldGoalsMade>percent_assisted_field_goals_made:f
        percentUnassistedFieldGoalsMade>percent_unassisted_field_goals_made:f
        percentTeamFieldGoalsMade>percent_team_field_goals_made:f
        percentTeamFieldGoalsAttempted>percent_team_field_goals_attempted:f
        percentTeamThreePointersMade>percent_team_three_pointers_made:f
        percentTeamThreePointersAttempted>percent_team_three_pointers_attempted:f
        percentTeamFreeThrowsMade>percent_team_free_throws_made:f
        percentTeamFreeThrowsAttempted>percent_team_free_throws_attempted:f
        percentTeamOffensiveRebounds>percent_team_offensive_rebounds:f
    """),
    "stg_nba_kaggle_players": ("nba_raw.players", """
        personId>person_id:i firstName>first_name:s lastName>last_name:s birthDate>birth_date:d school:s
        country:s heightInches>height_inches:i bodyWeightLbs>body_weight_lbs:i jersey:s guard:i forward:i
        center:i dleagueFlag>dleague_flag:i nbaFlag>nba_flag:i gamesPlayedFlag>games_played_flag:i
        draftYear>draft_year:i draftRound>draft_round:i draftNumber>draft_number:i fromYear>from_year:i
        toYear>to_year:i
    """),
    "stg_nba_kaggle_team_histories": ("nba_raw.team_histories", """
        teamId>team_id:i teamCity>team_city:s teamName>team_name:s teamAbbrev>team_abbrev:s
        seasonFounded>season_founded:i seasonActiveTill>season_active_till:i league:s
    """),
    "stg_nba_kaggle_team_statistics": ("nba_raw.team_statistics", """
        gameId>game_id:i gameDateTimeEst>game_date_time_est:t teamCity>team_city:s teamName>team_name:s
        teamId>team_id:i opponentTeamCity>opponent_team_city:s opponentTeamName>opponent_team_name:s
        opponentTeamId>opponent_team_id:i home:i win:i teamScore>team_score:i opponentScore>opponent_score:i
        assists:i blocks:i steals:i fieldGoalsAttempted>field_goals_attempted:i
        fieldGoalsMade>field_goals_made:i fieldGoalsPercentage>field_goals_percentage:f
        threePointersAttempted>three_pointers_attempted:i threePointersMade>three_pointers_made:i
        threePointersPercentage>three_pointers_percentage:f freeThrowsAttempted>free_throws_attempted:i
        freeThrowsMade>free_throws_made:i freeThrowsPercentage>free_throws_percentage:f
        reboundsDefensive>rebounds_defensive:i reboundsOffensive>rebounds_offensive:i
        reboundsTotal>rebounds_total:i foulsPersonal>fouls_personal:i turnovers:i
        plusMinusPoints>plus_minus_points:i numMinutes>num_minutes:f q1Points>q1_points:i
        q2Points>q2_points:i q3Points>q3_points:i q4Points>q4_points:i benchPoints>bench_points:i
        biggestLead>biggest_lead:i biggestScoringRun>biggest_scoring_run:i leadChanges>lead_changes:i
        pointsFastBreak>points_fast_break:i pointsFromTurnovers>points_from_turnovers:i
        pointsInThePaint>points_in_the_paint:i pointsSecondChance>points_second_chance:i
        timesTied>times_tied:i timeoutsRemaining>timeouts_remaining:i seasonWins>season_wins:i
        seasonLosses>season_losses:i coachId>coach_id:s gameType>game_type:s gameLabel>game_label:s
        gameSubLabel>game_sub_label:s seriesGameNumber>series_game_number:i seed:i
        reboundsTeam>rebounds_team:i turnoversTeam>turnovers_team:i ot1Points>ot1_points:i
        ot2Points>ot2_points:i otAllPoints>ot_all_points:i gameDate>game_date:t
    """),
    "stg_nba_kaggle_team_statistics_extended": ("nba_raw.team_statistics_extended", """
        gameId>game_id:i gameDateTimeEst>game_date_time_est:t gameType>game_type:s gameLabel>game_label:s
        gameSubLabel>game_sub_label:s seriesGameNumber>series_game_number:s teamId>team_id:i
        teamCity>team_city:s teamName>team_name:s opponentTeamId>opponent_team_id:i
        opponentTeamCity>opponent_team_city:s opponentTeamName>opponent_team_name:s home:i win:i
        teamScore>team_score:i opponentScore>opponent_score:i seed:i numMinutes>num_minutes:f assists:i
        steals:i blocks:i blocksAgainst>blocks_against:i fieldGoalsMade>field_goals_made:i
        fieldGoalsAttempted>field_goals_attempted:i fieldGoalsPercentage>field_goals_percentage:f
        threePointersMade>three_pointers_made:i threePointersAttempted>three_pointers_attempted:i
        threePointersPercentage>three_pointers_percentage:f freeThrowsMade>free_throws_made:i
        freeThrowsAttempted>free_throws_attempted:i freeThrowsPercentage>free_throws_percentage:f
        reboundsOffensive>rebounds_offensive:i reboundsDefensive>rebounds_defensive:i
        reboundsTotal>rebounds_total:i reboundsTeam>rebounds_team:i foulsPersonal>fouls_personal:i
        personalFoulsDrawn>personal_fouls_drawn:i turnovers:i turnoversTeam>turnovers_team:i
        plusMinusPoints>plus_minus_points:i q1Points>q1_points:i q2Points>q2_points:i q3Points>q3_points:i
        q4Points>q4_points:i ot1Points>ot1_points:i ot2Points>ot2_points:i otAllPoints>ot_all_points:i
        benchPoints>bench_points:i biggestLead>biggest_lead:i biggestScoringRun>biggest_scoring_run:i
        leadChanges>lead_changes:i pointsFastBreak>points_fast_break:i
        pointsFromTurnovers>points_from_turnovers:i pointsInThePaint>points_in_the_paint:i
        pointsSecondChance>points_second_chance:i timesTied>times_tied:i
        timeoutsRemaining>timeouts_remaining:i seasonWins>season_wins:i seasonLosses>season_losses:i
        estimatedOffensiveRating>estimated_offensive_rating:f offensiveRating>offensive_rating:f
        estimatedDefensiveRating>estimated_defensive_rating:f defensiveRating>defensive_rating:f
        estimatedNetRating>estimated_net_rating:f netRating>net_rating:f
        assistPercentage>assist_percentage:f assistToTurnoverRatio>assist_to_turnover_ratio:f
        assistRatio>assist_ratio:f offensiveReboundPercentage>offensive_rebound_percentage:f
        defensiveReboundPercentage>defensive_rebound_percentage:f reboundPercentage>rebound_percentage:f
        teamTurnoverPercentage>team_turnover_percentage:f
        effectiveFieldGoalPercentage>effective_field_goal_percentage:f
        trueShootingPercentage>true_shooting_percentage:f estimatedPace>estimated_pace:f pace:f
        pacePer40>pace_per_40:f possessions:f playerImpactEstimate>player_impact_estimate:f
        pointsOffTurnovers>points_off_turnovers:i opponentPointsOffTurnovers>opponent_points_off_turnovers:i
        opponentPointsSecondChance>opponent_points_second_chance:i
        opponentPointsFastBreak>opponent_points_fast_break:i
        opponentPointsInPaint>opponent_points_in_paint:i
        percentFieldGoalAttempts2Point>percent_field_goal_attempts_2_point:f
        percentFieldGoalAttempts3Point>percent_field_goal_attempts_3_point:f
        percentPoints2Point>percent_points_2_point:f
        percentPoints2PointMidRange>percent_points_2_point_mid_range:f
        percentPoints3Point>percent_points_3_point:f percentPointsFastBreak>percent_points_fast_break:f
        percentPointsFreeThrow>percent_points_free_throw:f
        percentPointsOffTurnovers>percent_points_off_turnovers:f
        percentPointsInPaint>percent_points_in_paint:f
        percentAssisted2PointMade>percent_assisted_2_point_made:f
        percentUnassisted2PointMade>percent_unassisted_2_point_made:f
        percentAssisted3PointMade>percent_assisted_3_point_made:f
        percentUnassisted3PointMade>percent_unassisted_3_point_made:f
        percentAssistedFieldGoalsMade>percent_assisted_field_goals_made:f
        percentUnassistedFieldGoalsMade>percent_unassisted_field_goals_made:f
        freeThrowAttemptRate>free_throw_attempt_rate:f
    """),
    "stg_nba_betting_money_line": ("nba_odds_raw.nba_betting_money_line", """
        game_id:i book_name:s book_id:i team_id:i a_team_id:i price1:f price2:f
    """),
    "stg_nba_betting_players_all": ("nba_odds_raw.nba_players_all", """
        person_id:i display_last_comma_first:s display_first_last:s rosterstatus:b from_year:i to_year:i
        playercode:s games_played_flag:b position:s draft_year:i draft_round:i draft_num:s birth_date:s
        height_feet:i height_inches:i height:f weight:i season_exp:i jersey:s school:s country:s
        last_affiliation:s
    """),
    "stg_nba_betting_players_game_stats": ("nba_odds_raw.nba_players_game_stats", """
        season_id:i player_id:i player_name:s team_id:i team_abbreviation:s team_name:s game_id:i
        game_date:d matchup:s wl:s min:i fgm:i fga:i fg_pct:f fg3m:s fg3a:s fg3_pct:s ftm:i fta:i ft_pct:f
        oreb:s dreb:s reb:i ast:i stl:s blk:s tov:s pf:i pts:i plus_minus:s season_type:s season_year:i
        season:s
    """),
    "stg_nba_betting_series_odds": ("nba_odds_raw.nba_betting_series_odds", """
        year:i conference:s round:s home_team:s home_seed:i home_odds:fn away_team:s away_seed:i
        away_odds:fn winner:s series_score:s games_in_series:i home_id:i away_id:i winner_id:i
    """),
    "stg_nba_betting_spread": ("nba_odds_raw.nba_betting_spread", """
        game_id:i book_name:s book_id:i team_id:i a_team_id:i spread1:f spread2:f price1:f price2:f
    """),
    "stg_nba_betting_teams_all": ("nba_odds_raw.nba_teams_all", """
        league_id:i team_id:i min_year:i max_year:i abbreviation:s
    """),
    "stg_nba_betting_totals": ("nba_odds_raw.nba_betting_totals", """
        game_id:i book_name:s book_id:i team_id:i a_team_id:i total1:f total2:f price1:f price2:f
    """),
    "stg_nba_all_time": ("nba_elo.nba_elo_all_time", """
        game_id:s! date>date_game:dp season:i is_playoff:i neutral:i home_franch>team_id:s!
        away_franch>opp_id:s! home_pts:i away_pts:i mov:i home_win:i elo_home_reg_pre:f elo_away_reg_pre:f
        elo_home_po_pre:f elo_away_po_pre:f p_home_reg:f p_home_po:f p_home_used:f delta_reg:f delta_po:f
        elo_home_reg_post:f elo_away_reg_post:f elo_home_po_post:f elo_away_po_post:f
    """),
    "stg_nba_elo_playoffs_post_1977": ("nba_elo.nba_elo_playoffs_post1977", """
        gameorder>game_order:i game_id:s lg_id:s _iscopy>is_copy:i year_id:i date_game:d
        seasongame>season_game:i is_playoffs:i team_id:s fran_id:s pts:i elo_i:f elo_n:f win_equiv:f
        opp_id:s opp_fran:s opp_pts:i opp_elo_i:f opp_elo_n:f game_location:s game_result:s forecast:f
        notes:s
    """),
    "stg_nba_elo_playoffs_pre_1976": ("nba_elo.nba_elo_playoffs_pre1976", """
        gameorder>game_order:i game_id:s lg_id:s _iscopy>is_copy:i year_id:i date_game:d
        seasongame>season_game:i is_playoffs:i team_id:s fran_id:s pts:i elo_i:f elo_n:f win_equiv:f
        opp_id:s opp_fran:s opp_pts:i opp_elo_i:f opp_elo_n:f game_location:s game_result:s
    """),
    "stg_nba_elo_post_1977": ("nba_elo.nba_elo_post77", """
        gameorder>game_order:i game_id:s lg_id:s _iscopy>is_copy:i year_id:i date_game:d
        seasongame>season_game:i is_playoffs:i team_id:s fran_id:s pts:i elo_i:f elo_n:f win_equiv:f
        opp_id:s opp_fran:s opp_pts:i opp_elo_i:f opp_elo_n:f game_location:s game_result:s forecast:f
        notes:s
    """),
    "stg_nba_elo_pre_1976": ("nba_elo.nba_elo_pre1976", """
        gameorder>game_order:i game_id:s lg_id:s _iscopy>is_copy:i year_id:i date_game:d
        seasongame>season_game:i is_playoffs:i team_id:s fran_id:s pts:i elo_i:f elo_n:f win_equiv:f
        opp_id:s opp_fran:s opp_pts:i opp_elo_i:f opp_elo_n:f game_location:s game_result:s
    """),
}

# Row filters applied after conforming, by model.
STAGING_FILTERS: dict[str, str] = {
    "stg_nba_kaggle_team_histories": "league = 'NBA'",
}

# Models derived from another model's spec plus a filter.
DERIVED_MODELS: dict[str, tuple[str, str]] = {
    "stg_nba_all_time_playoffs": ("stg_nba_all_time", "is_playoff = 1"),
}
