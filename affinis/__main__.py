from affinis.plans.experiments import main

main()
